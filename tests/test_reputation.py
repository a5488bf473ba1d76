"""Reputation: whole-data, trailing window edges, both physical forms."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veracity.operators import reputation as R

SCHEMA = "row_key long, source_id string, timestamp timestamp, is_anomaly boolean"
T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _frame(spark, rows):
    return spark.createDataFrame(
        [(k, s, T0 + dt.timedelta(seconds=off) if off is not None else None, a)
         for k, s, off, a in rows], SCHEMA)


ROWS = [(1, "a", 0, True), (2, "a", 3600, False), (3, "a", 3601, False),
        (4, "a", 3601.5, True), (5, "b", 10, True), (6, None, 5, True),
        (7, "a", None, False), (8, "a", None, True)]


@pytest.mark.parametrize("chunk", [1800, 86_400])
def test_window_edges(spark, chunk):
    df = _frame(spark, ROWS)
    out = {r.row_key: r for r in R.compute_source_reputation_streaming(
        df, 3600, chunk_seconds=chunk).collect()}
    assert out[2].total_in_window == 2        # frame inclusive at 3600 s
    assert out[3].total_in_window == 3        # t+3601 leaves t out ...
    assert out[3].anomalies_in_window == 1    # ... and counts its peer
    assert out[4].total_in_window == 3        # same-second peers counted
    assert out[6].total_in_window == 1        # null source: its own group
    assert out[7].total_in_window == 2        # null times: peers of each other
    assert out[8].source_reputation == pytest.approx(0.5)


def _direct(df, seconds):
    """The textbook form: one window per source over the records."""
    w = (Window.partitionBy("source_id").orderBy("__sec")
         .rangeBetween(-seconds, 0))
    return df.withColumn("__sec", R.epoch_seconds("timestamp")).select(
        "row_key", F.sum(F.col("is_anomaly").cast("long")).over(w).alias("a"),
        F.count(F.lit(1)).over(w).alias("n"))


def test_chunked_equals_direct_on_events(spark):
    from veracity.plans.catalog_windows import flagged_events
    df = flagged_events(spark, "/root/testdata/sf0.001")
    cols = ["row_key", "anomalies_in_window", "total_in_window"]
    a = _direct(df, 3600)
    b = R.compute_source_reputation_streaming(df, chunk_seconds=7200)
    assert sorted(map(tuple, a.collect())) == sorted(
        map(tuple, b.select(cols).collect()))


def test_chunked_ema_equals_one_fold(spark):
    rows = [(i, "ab"[i % 2], 600 * (i * i % 977), i % 3 == 0)
            for i in range(400)]
    df = _frame(spark, rows)
    ema = R.compute_source_reputation_exponential_moving_average
    a = {r.row_key: r.ema_anomaly_rate for r in ema(df).collect()}
    b = {r.row_key: r.ema_anomaly_rate
         for r in ema(df, chunk_buckets=7).collect()}
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("alpha", [0.001, 0.3, 0.9, 0.999, 1.0])
def test_ema_is_the_recurrence(spark, alpha):
    """Long series, gaps, a null source, a source with one bucket."""
    rows = [(i, "s" if i % 5 else None, 600 * (i + i // 97 * 4000),
             i % 7 in (0, 3)) for i in range(6000)]
    rows += [(9000, "one", 600, True)]
    df = _frame(spark, rows)
    out = R.compute_source_reputation_exponential_moving_average(
        df, alpha).collect()
    got = {r.row_key: r.ema_anomaly_rate for r in out}
    for source in ("s", None, "one"):
        value = None
        for key, _, _, flag in (r for r in rows if r[1] == source):
            value = float(flag) if value is None else (
                alpha * flag + (1 - alpha) * value)
            assert got[key] == pytest.approx(value, rel=1e-9, abs=1e-12)


def test_ema_stays_in_the_jvm(spark):
    from veracity.plans.catalog_windows import q_ema_reputation
    plan = q_ema_reputation(spark, "/root/testdata/sf0.001"
                            )._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_broadcast_is_decided_by_bytes(spark):
    from veracity.operators.lookup import lookup_join, table_bytes
    big = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert 50_000 < table_bytes(big) < 60_000
    for limit, join in ((10 ** 6, "BroadcastHashJoin"), (10, "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = lookup_join(spark.range(9), big, ["id"],
                           max_broadcast_bytes=limit)
        assert join in plan._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_data_reputation_and_null_source(spark):
    df = _frame(spark, ROWS)
    out = {r.row_key: r.source_reputation
           for r in R.compute_source_reputation(df).collect()}
    assert out[1] == pytest.approx(1 - 3 / 6)
    assert out[5] == 0.0                        # all-anomalous source
    assert out[6] is None                       # null source: no reputation


def test_bucketed_plan_has_no_single_partition_window(spark):
    from veracity.plans.catalog_windows import flagged_events
    df = R.compute_source_reputation_streaming(
        flagged_events(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_parse_duration():
    assert R.parse_duration("1 hour") == 3600
    assert R.parse_duration("30 minutes") == 1800      # not 30 hours
    assert R.parse_duration("10 minutes") == 600


@pytest.mark.parametrize("window, chunk", [(3600, 1500), (600, 86_400),
                                           (7, 1), (5, 5), (4, 5)])
def test_trailing_counts_of_full_seconds(spark, window, chunk):
    """A row in nearly every second, before 1970 too, flags that are not
    known, seconds that start a chunk: as one window over the records, but
    by running sums, whose work is not the window's rows times its own."""
    rows = [(i, "ab"[i % 2], None if i % 41 == 0 else i * 7 // 5 - 3000,
             None if i % 5 == 0 or i < 900 else i % 3 == 0)
            for i in range(6000)]
    df = _frame(spark, rows).withColumn("timestamp", F.expr(
        "timestamp - interval 19723 days - interval 12 hours"))
    got = R.compute_source_reputation_streaming(df, window,
                                                chunk_seconds=chunk)
    assert sorted(map(repr, _direct(df, window).collect())) == sorted(
        map(repr, got.select("row_key", F.col("anomalies_in_window").alias(
            "a"), F.col("total_in_window").alias("n")).collect()))
    plan = R._trailing_counts(df, window, "source_id", "is_anomaly",
                              "timestamp", chunk
                              )._jdf.queryExecution().toString()
    assert "unboundedpreceding" in plan
    assert f"RangeFrame, -{window}" not in plan
