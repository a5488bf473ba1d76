"""Per-source reports, summaries, top-k, bands, alerts, samples.

All are aggregations with map-side partial aggregation, so a hot source
costs one small partial row per task, never a big group in one task.  The
top-k is a per-partition top-k plus one bounded merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import key_hash
from ..functions.trust import rate_alert, severity_level, trust_band
from ..params import ALERT_RATE, HIGH_SEVERITY
from .numbering import first_rows




def trust_by_source(df: DataFrame, source_col: str = "source_id"
                    ) -> DataFrame:
    """Average trust (2 places), completeness and accuracy (3 places)."""
    return (df.groupBy(source_col).agg(
        F.round(F.avg("trust_score"), 2).alias("avg_trust_score"),
        F.round(F.avg("completeness"), 3).alias("avg_completeness"),
        F.round(F.avg("accuracy"), 3).alias("avg_accuracy"))
        .orderBy(source_col))


def quality_matrix(df: DataFrame, source_col: str = "source_id") -> DataFrame:
    """Per-source means behind the comparison chart.

    A frame without ``freshness`` counts it as 1.0.
    """
    fresh = F.col("freshness") if "freshness" in df.columns else F.lit(1.0)
    return df.groupBy(source_col).agg(
        F.avg("completeness").alias("avg_completeness"),
        F.avg("accuracy").alias("avg_accuracy"),
        F.avg(fresh).alias("avg_freshness"),
        F.avg("source_reputation").alias("avg_reputation"),
        F.sum(F.col("is_anomaly").cast("long")).alias("anomaly_count"),
        F.avg("trust_score").alias("avg_trust"))


# --- fixed values: radar axis labels, in drawing order ---
RADAR_AXES = (("Completeness", "avg_completeness"),
              ("Accuracy", "avg_accuracy"),
              ("Freshness", "avg_freshness"),
              ("Reputation", "avg_reputation"))
# --- end of fixed values ---


def radar_series(matrix: DataFrame, source_col: str = "source_id"
                 ) -> DataFrame:
    """The quality matrix as (source, point, metric, value x 100),
    the first axis repeated as a last point to close the loop."""
    axes = list(RADAR_AXES) + [RADAR_AXES[0]]
    args = ", ".join(f"{i}, '{label}', {col} * 100.0"
                     for i, (label, col) in enumerate(axes))
    return matrix.selectExpr(
        f"`{source_col}`",
        f"stack({len(axes)}, {args}) as (point, metric, value)")


def trust_summary(df: DataFrame) -> DataFrame:
    """One row of dashboard figures; none for an empty input.

    Percentages are rounded to 2 places; a null mean reads as 0; a null
    flag counts as not anomalous.
    """
    n = F.count(F.lit(1))
    flagged = F.sum(F.when(F.col("is_anomaly") == F.lit(True), 1).otherwise(0))
    pct = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)) * 100.0, 2)
    return (df.agg(n.alias("total_records"),
                   pct("completeness").alias("completeness"),
                   pct("accuracy").alias("accuracy"),
                   F.round(flagged / n * 100.0, 2).alias("anomaly_rate"),
                   pct("source_reputation").alias("reputation"),
                   F.round(F.coalesce(F.avg("trust_score"), F.lit(0.0)), 2)
                   .alias("trust_score"))
            .where(F.col("total_records") > 0))


TOP_COLUMNS = ("user_id", "source_id", "amount", "trust_score",
               "anomaly_severity")


def top_anomalies(df: DataFrame, k: int = 10,
                  columns: Sequence[str] = TOP_COLUMNS) -> DataFrame:
    """P5: the k most severe flagged rows; ties broken on the other
    output columns so the answer is deterministic."""
    cols = [c for c in columns if c in df.columns]
    order = [F.col("anomaly_severity").desc_nulls_last()] + [
        F.col(c).asc_nulls_last() for c in cols if c != "anomaly_severity"]
    return (df.where(F.col("is_anomaly") == F.lit(True))
            .select(*cols).orderBy(*order).limit(int(k)))


def with_trust_band(df: DataFrame, score_col: str = "trust_score"
                    ) -> DataFrame:
    """Add ``trust_band``."""
    return df.withColumn("trust_band", trust_band(score_col))


def trust_bands(df: DataFrame, score_col: str = "trust_score") -> DataFrame:
    """P9 as a report: rows per band."""
    return (with_trust_band(df, score_col).groupBy("trust_band")
            .agg(F.count(F.lit(1)).alias("records")))


def anomaly_alerts(df: DataFrame, source_col: str = "source_id",
                   rate_limit: float = ALERT_RATE,
                   high: float = HIGH_SEVERITY) -> DataFrame:
    """P10: per source, anomaly rate, the rate alert and how many flagged
    rows are of high severity."""
    flagged = F.col("is_anomaly") == F.lit(True)
    level = severity_level("anomaly_severity", high)
    stats = df.groupBy(source_col).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.when(flagged, 1).otherwise(0)).alias("anomalies"),
        F.sum(F.when(flagged & (level == "high"), 1).otherwise(0))
        .alias("high_severity"),
        F.sum(F.when(flagged & (level == "medium"), 1).otherwise(0))
        .alias("medium_severity"))
    rate = F.col("anomalies") / F.col("records")
    return stats.withColumns({"anomaly_rate": rate,
                              "rate_alert": rate_alert(rate, rate_limit)})


def record_count(df: DataFrame) -> DataFrame:
    """P7 as a frame (``df.count()`` is the action form)."""
    return df.agg(F.count(F.lit(1)).alias("records"))


def hash_sample(df: DataFrame, fraction: float, key_cols: Sequence[str],
                seed: int = 42, method: str = "xxhash64") -> DataFrame:
    """A Bernoulli sample decided by a hash of the key, so the
    same rows are chosen whatever the partitioning."""
    cut = int(round(min(max(fraction, 0.0), 1.0) * 2 ** 32))
    return df.where(key_hash(key_cols, seed, method) < F.lit(cut))


def exact_sample(df: DataFrame, n: int, key_cols: Sequence[str],
                 seed: int = 42, method: str = "xxhash64") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the ones with the smallest key
    hashes (ties by the key).  A large n is a filter, not a merge
    (``numbering.first_rows``)."""
    h = key_hash(key_cols, seed, method)
    return first_rows(df.withColumn("__h", h), "__h", int(n), key_cols
                      ).drop("__h")


def persist_scored(df: DataFrame) -> DataFrame:
    """Keep a scored frame for several reports (memory, then disk)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
