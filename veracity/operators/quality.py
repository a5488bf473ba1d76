"""Q1-Q8: per-record quality dimensions as one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions.parsing import parse_timestamp
from ..params import QualityParams


def compute_quality_metrics(df: DataFrame,
                            params: QualityParams | None = None,
                            as_of=None,
                            with_score: bool = False) -> DataFrame:
    """Add completeness, consistency, accuracy, freshness, timeliness.

    Works unchanged on bounded and streaming frames (no aggregation, no
    shuffle: one ``Project`` that stays in whole-stage codegen).  ``as_of``
    fixes "now" for freshness; ``current_timestamp()`` when omitted.  When
    the frame has no ingestion column, ingestion is taken to be ``as_of``.
    """
    p = params or QualityParams.batch()
    fields = (list(p.completeness_fields) if p.completeness_fields
              else q.completeness_fields(df.columns))
    ingestion = (_as_time(df, p.ingestion_col) if p.ingestion_col in df.columns
                 else q.as_of_column(as_of))
    ts = _as_time(df, p.timestamp_col)
    cols = {
        "completeness": q.completeness(fields, df.columns),
        "consistency": q.consistency(p.amount_col),
        "accuracy": q.accuracy(p.amount_col, p.max_amount),
        "freshness": q.freshness(ts, as_of, p.freshness_days),
        "timeliness": q.timeliness(ts, ingestion,
                                   p.grace_days, p.horizon_days),
    }
    out = df.withColumns({k: v.cast("double") for k, v in cols.items()})
    if with_score:
        out = out.withColumn("quality_score", q.quality_score())
    return out


def _as_time(df: DataFrame, name: str):
    """A date/timestamp column as is; text is parsed leniently, so an
    unparsable value counts as a missing time instead of failing the job
    (ANSI mode throws on an implicit string-to-date cast)."""
    kind = dict(df.dtypes).get(name, "")
    if kind.startswith(("timestamp", "date")):
        return F.col(name)
    return parse_timestamp(name)


# Names used by the reference's batch and streaming modules.
compute_quality_metrics_streaming = compute_quality_metrics
