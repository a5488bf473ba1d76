"""Decay, trust, bands; golden values of the stored reference run."""

import math

import pytest
from pyspark.sql import functions as F

from veracity.functions.trust import temporal_decay, trust_band, trust_score
from veracity.operators.trust import compute_trust_score
from veracity.params import TrustParams

AS_OF = "2024-02-01 00:00:00"


def _scored(spark, dims, rep, ingest="2024-02-01 00:00:00"):
    cols = "completeness double, consistency double, accuracy double, " \
           "freshness double, timeliness double, source_reputation double, " \
           "ingestion_timestamp string"
    df = spark.createDataFrame([(*dims, rep, ingest)], cols).withColumn(
        "ingestion_timestamp", F.col("ingestion_timestamp").cast("timestamp"))
    return df


def test_golden_minimum_and_maximum(spark):
    lo = _scored(spark, (0.6, 0.0, 0.0, 0.0, 15 / 38), 0.9489062169953619)
    hi = _scored(spark, (1.0,) * 5, 0.9496468979051753)
    p = TrustParams.streaming()
    assert compute_trust_score(lo, p, AS_OF).first().trust_score == \
        pytest.approx(18.878239474960356, rel=1e-12)
    assert compute_trust_score(hi, p, AS_OF).first().trust_score == \
        pytest.approx(94.96468979051753, rel=1e-12)


def test_decay_before_and_after(spark):
    a = _scored(spark, (1.0,) * 5, 1.0, "2024-01-29 00:00:00")
    b = _scored(spark, (1.0,) * 5, 1.0, "2024-02-02 00:00:00")
    assert compute_trust_score(a, as_of=AS_OF).first().temporal_decay == \
        pytest.approx(math.exp(-0.15))
    assert compute_trust_score(b, as_of=AS_OF).first().temporal_decay == \
        pytest.approx(math.exp(0.05))      # above 1, no clamp


def test_null_reputation_batch_vs_stream(spark):
    d = _scored(spark, (1.0,) * 5, None)
    assert compute_trust_score(d, TrustParams.batch(), AS_OF).first().trust_score is None
    assert compute_trust_score(d, TrustParams.streaming(), AS_OF).first() \
        .trust_score == pytest.approx(50.0)


def test_all_anomalous_source_scores_zero(spark):
    d = _scored(spark, (1.0,) * 5, 0.0)
    assert compute_trust_score(d, as_of=AS_OF).first().trust_score == 0.0


@pytest.mark.parametrize("score,band", [(80.0, "High Trust"),
                                        (79.99, "Moderate Trust"),
                                        (50.0, "Moderate Trust"),
                                        (49.99, "Critical Risk")])
def test_bands(spark, score, band):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(trust_band("s")).first()[0] == band


def test_expressions_are_builtin(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "q double, r double")
    out = df.select(trust_score(F.col("q"), F.col("r"),
                                temporal_decay(F.lit("2024-02-01").cast("timestamp"),
                                               AS_OF, 0.05)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
