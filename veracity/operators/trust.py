"""Temporal decay and the 0-100 trust score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import trust as t
from ..params import TrustParams


def apply_temporal_decay(df: DataFrame, params: TrustParams | None = None,
                         as_of=None) -> DataFrame:
    """``temporal_decay`` = exp(-rate * days(as_of - age column))."""
    p = params or TrustParams.batch()
    return df.withColumn("temporal_decay",
                         t.temporal_decay(p.age_col, as_of, p.decay_rate))


def compute_trust_score(df: DataFrame, params: TrustParams | None = None,
                        as_of=None, with_quality_score: bool = False,
                        with_age: bool = False) -> DataFrame:
    """trust = mean(5 dimensions) * reputation * decay * 100.

    Batch keeps a null reputation null (so the trust is null); the
    streaming parameters replace it with 0.5.  No clamp unless asked.
    """
    p = params or TrustParams.batch()
    cols = {}
    if with_age:
        cols["days_old"] = q.day_diff(q.as_of_column(as_of), p.age_col)
    cols["temporal_decay"] = t.temporal_decay(p.age_col, as_of, p.decay_rate)
    out = df.withColumns(cols)
    quality = q.quality_score()
    if with_quality_score:
        out = out.withColumn("quality_score", quality)
        quality = F.col("quality_score")
    return out.withColumn(
        "trust_score",
        t.trust_score(quality, F.col("source_reputation"),
                      F.col("temporal_decay"), p.default_reputation, p.clamp))


def compute_trust_score_streaming(df: DataFrame, as_of=None,
                                  params: TrustParams | None = None
                                  ) -> DataFrame:
    return compute_trust_score(df, params or TrustParams.streaming(), as_of)
