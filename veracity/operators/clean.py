"""Record cleaning with rejects, replay slices, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import as_of_column
from .numbering import first_rows


def _text(df: DataFrame, name: str, absent: str | None) -> F.Column:
    """Trimmed text; a null cell reads as '' (the CSV reader's empty)."""
    if name not in df.columns:
        return F.lit(absent)
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def cleaned_columns(df: DataFrame, as_of=None) -> dict[str, F.Column]:
    """The producer's cleaning of one raw row, as column expressions.

    Strings trimmed; ``source_id`` absent -> ``unknown``; ``timestamp``
    absent -> ``as_of`` in ISO text; ``city`` absent -> ''; amount absent
    -> 0.0, blank or unparsable -> null.
    """
    now_text = F.date_format(as_of_column(as_of), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if "purchase_amount" in df.columns:
        amount = F.trim(F.col("purchase_amount").cast("string")).try_cast("double")
    else:
        amount = F.lit(0.0)
    ts = (_text(df, "timestamp", None) if "timestamp" in df.columns
          else now_text)
    return {"user_id": _text(df, "user_id", ""),
            "source_id": _text(df, "source_id", "unknown"),
            "timestamp": ts,
            "city": _text(df, "city", ""),
            "purchase_amount": amount.cast("double")}


def _valid() -> F.Column:
    return (F.length(F.col("user_id")) > 0) & (F.length(F.col("timestamp")) > 0)


def clean_records(df: DataFrame, as_of=None, keep=()) -> DataFrame:
    """Cleaned records that carry a user id and a timestamp."""
    cols = cleaned_columns(df, as_of)
    out = df.select(*keep, *[c.alias(n) for n, c in cols.items()])
    return out.where(_valid())


def reject_records(df: DataFrame, as_of=None, keep=()) -> DataFrame:
    """The complement of ``clean_records``, with the field that lacks."""
    cols = cleaned_columns(df, as_of)
    out = df.select(*keep, *[c.alias(n) for n, c in cols.items()])
    reason = F.when(F.length(F.col("user_id")) == 0,
                    "no_user_id").otherwise("no_timestamp")
    return out.where(~_valid()).withColumn("reject_reason", reason)


def replay_slice(df: DataFrame, row_col: str, start_row: int = 0,
                 max_records: int | None = None, as_of=None) -> DataFrame:
    """Skip rows before ``start_row``, then the first ``max_records``
    good rows in row order (0 or None: all).  Rejected rows do not count.
    The cap is the feature here; ``numbering.first_rows`` keeps a large one
    distributed.  ``sources.files.read_csv_rows`` numbers the rows of a
    file."""
    good = clean_records(df.where(F.col(row_col) >= start_row), as_of,
                         keep=(row_col,))
    if max_records:
        good = first_rows(good, row_col, int(max_records))
    return good


# --- fixed values: output column lists ---
OUTPUT_FULL = ("user_id", "source_id", "purchase_amount", "city",
               "timestamp", "completeness", "consistency", "accuracy",
               "freshness", "timeliness", "is_anomaly", "anomaly_severity",
               "source_reputation", "temporal_decay", "trust_score")
OUTPUT_SHORT = ("user_id", "source_id", "timestamp", "is_anomaly",
                "source_reputation", "trust_score")
BATCH_SINGLE = ("user_id", "source_id", "completeness", "consistency",
                "accuracy", "freshness", "timeliness", "is_anomaly",
                "source_reputation", "temporal_decay", "trust_score")
BATCH_MULTI = ("user_id", "source_id", "amount", "city", "completeness",
               "consistency", "accuracy", "freshness", "timeliness",
               "is_anomaly", "source_reputation", "temporal_decay",
               "trust_score")
# --- end of fixed values ---


def prepare_output_columns(df: DataFrame, include_intermediate: bool = False
                           ) -> DataFrame:
    """The 15- or 6-column output, skipping absent columns."""
    wanted = OUTPUT_FULL if include_intermediate else OUTPUT_SHORT
    return df.select(*[c for c in wanted if c in df.columns])


def final_projection(df: DataFrame, multi_source: bool = True) -> DataFrame:
    """The 13-column (multi-source) or 11-column batch output."""
    return df.select(*(BATCH_MULTI if multi_source else BATCH_SINGLE))
