"""Hand-computed edge rows (FIXTURES section 4), streaming constants."""

import pytest
from pyspark.sql import functions as F

from veracity.operators.quality import compute_quality_metrics
from veracity.params import QualityParams

AS_OF = "2024-02-01 00:00:00"
SCHEMA = ("user_id string, purchase_amount double, city string, "
          "timestamp timestamp, source_id string, ingestion_timestamp timestamp")


def _rows(spark, rows):
    import datetime as dt
    conv = []
    for u, a, c, t, s in rows:
        ts = dt.datetime.fromisoformat(t) if t else None
        conv.append((u, a, c, ts, s, dt.datetime(2024, 2, 1)))
    df = spark.createDataFrame(conv, SCHEMA)
    return compute_quality_metrics(df, QualityParams.streaming(), AS_OF)


def _one(spark, **kw):
    row = dict(u="u1", a=10.0, c="NYC", t="2024-02-01T00:00:00", s="web")
    row.update(kw)
    return _rows(spark, [(row["u"], row["a"], row["c"], row["t"], row["s"])]).first()


def test_complete_today(spark):
    r = _one(spark)
    assert (r.completeness, r.consistency, r.accuracy, r.freshness,
            r.timeliness) == (1.0, 1.0, 1.0, 1.0, 1.0)


def test_future_and_day_boundary(spark):
    assert _one(spark, t="2024-02-05T00:00:00").freshness == 1.0
    assert _one(spark, t="2024-02-05T00:00:00").timeliness == 1.0
    r = _one(spark, t="2024-01-31T23:59:59")
    assert r.freshness == pytest.approx(1 - 1 / 30)


def test_freshness_limit_grace_horizon(spark):
    r = _one(spark, t="2024-01-02T00:00:00")          # 30 days
    assert r.freshness == 0.0
    assert r.timeliness == pytest.approx(15 / 38)
    assert _one(spark, t="2024-01-25T00:00:00").timeliness == 1.0   # 7 days
    assert _one(spark, t="2024-01-24T00:00:00").timeliness == pytest.approx(1 - 1 / 38)
    assert _one(spark, t="2023-12-18T00:00:00").timeliness == 0.0   # 45 days


@pytest.mark.parametrize("amount,acc", [(0.0, 1.0), (10000.0, 1.0),
                                        (10000.01, 0.0), (-0.01, 0.0)])
def test_amount_bounds(spark, amount, acc):
    assert _one(spark, a=amount).accuracy == acc


def test_amount_null_and_nan(spark):
    r = _one(spark, a=None)
    assert (r.completeness, r.consistency, r.accuracy) == (0.8, 0.0, 0.0)
    r = _one(spark, a=float("nan"))
    assert (r.completeness, r.consistency, r.accuracy) == (1.0, 1.0, 0.0)


def test_empty_city_counts_and_null_timestamp(spark):
    assert _one(spark, c="").completeness == 1.0
    r = _one(spark, t=None)
    assert (r.freshness, r.timeliness, r.completeness) == (0.0, 0.0, 0.8)


def test_dynamic_completeness_ignores_derived(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    df = df.withColumn("is_anomaly", F.lit(None).cast("boolean"))
    out = compute_quality_metrics(df, QualityParams.batch(amount_col="a",
                                                          timestamp_col="c"),
                                  AS_OF)
    assert out.first().completeness == pytest.approx(2 / 3)


def test_stream_and_batch_frames_agree(spark):
    """The same projection on a bounded frame and on a stream."""
    from veracity.plans import catalog
    q = catalog.queries()
    a = q["stream_quality"](spark, "/root/testdata/sf0.001")
    b = q["quality_events_streaming"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
