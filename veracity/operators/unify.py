"""Raw feeds onto the unified record.

Every feed becomes one ``select`` over its scan; the union is
``unionByName``; cleaning is a filter plus a projection.  No step looks
at the data on the driver: schema decisions use the schema only.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import parse_timestamp
from ..functions.quality import as_of_column
from ..params import UNIFIED_COLUMNS
from ..sources.feeds import (ADHOC_ID_NAMES, ADHOC_NO_AMOUNT, ADHOC_SOURCE,
                             ADHOC_TEXT_DEFAULT, PERMISSIVE_MISSING_PREFIX,
                             PERMISSIVE_UNKNOWN_TAG, FeedMapping)
from .numbering import with_row_id

_NUMERIC_PREFIXES = ("int", "bigint", "smallint", "tinyint", "double",
                     "float", "decimal", "long")


def _names(spec) -> tuple[str, ...]:
    return tuple(spec) if isinstance(spec, (tuple, list)) else (spec,)


def _source(df: DataFrame, spec) -> Column | None:
    """The column(s) a target maps from; several candidates coalesce."""
    names = dict.fromkeys(_names(spec))
    present = [F.col(f"`{n}`") for n in names if n in df.columns]
    if not present:
        return None
    return present[0] if len(present) == 1 else F.coalesce(*present)


ROW_ID = "__row_id"


def _needs_id(df: DataFrame, m: FeedMapping) -> bool:
    return m.surrogate_user_id or (
        m.surrogate_if_missing is not None and "user_id" not in m.constants
        and _source(df, m.columns.get("user_id", "user_id")) is None)


def _identified(df: DataFrame, m: FeedMapping) -> DataFrame:
    """Rows with a generated id where the mapping asks for one."""
    return with_row_id(df, ROW_ID) if _needs_id(df, m) else df


def typed_unified(user_id: Column, amount: Column, city: Column,
                  timestamp: Column, source_id: Column,
                  ts_typed: bool = False) -> list[Column]:
    """The five unified columns with their types (lenient casts).

    ``ts_typed``: the timestamp already is a date/timestamp column and is
    cast, not parsed from text."""
    ts = (timestamp.cast("timestamp") if ts_typed
          else parse_timestamp(timestamp))
    return [user_id.cast("string").alias("user_id"),
            amount.try_cast("double").alias("amount")
            if amount is not None else F.lit(None).cast("double").alias("amount"),
            city.cast("string").alias("city"),
            ts.alias("timestamp"),
            source_id.cast("string").alias("source_id")]


def _mapped(df: DataFrame, m: FeedMapping, missing_literal: bool = False
            ) -> dict[str, Column]:
    cols = {}
    for target in UNIFIED_COLUMNS:
        c = None
        if target in m.constants:
            c = F.lit(m.constants[target])
        elif target in m.columns:
            c = _source(df, m.columns[target])
        if target == "user_id" and ROW_ID in df.columns:
            prefix = "" if m.surrogate_user_id else m.surrogate_if_missing
            c = F.concat(F.lit(prefix), F.col(ROW_ID))
        if target in m.defaults:
            c = (F.lit(m.defaults[target]) if c is None
                 else F.coalesce(c.cast("string"), F.lit(m.defaults[target])))
        if c is None:
            c = (F.lit(PERMISSIVE_MISSING_PREFIX + target) if missing_literal
                 else F.lit(None))
        cols[target] = c
    return cols


def map_feed(df: DataFrame, mapping: FeedMapping, keep=()) -> DataFrame:
    """Rename onto the unified record, tag the source, cast.

    ``keep`` passes extra columns (a row key) through in front."""
    df = _identified(df, mapping)
    c = _mapped(df, mapping)
    return df.select(*keep, *typed_unified(
        c["user_id"], c["amount"], c["city"], c["timestamp"], c["source_id"],
        ts_typed=_is_temporal(df, mapping.columns.get("timestamp"))))


def _is_temporal(df: DataFrame, spec) -> bool:
    types = dict(df.dtypes)
    names = _names(spec)
    found = [types[n] for n in names if n in types]
    return bool(found) and all(t.startswith(("timestamp", "date"))
                               for t in found)


def unify_feeds(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by column name, duplicates kept."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def clean_unified(df: DataFrame, as_of=None,
                  city_default: str = "unknown") -> DataFrame:
    """Drop null or non-positive amounts and null timestamps,
    default the city, stamp the ingestion time (``as_of``)."""
    return (df.where(F.col("amount").isNotNull() & (F.col("amount") > 0)
                     & F.col("timestamp").isNotNull())
            .withColumns({"city": F.coalesce(F.col("city"), F.lit(city_default)),
                          "ingestion_timestamp": as_of_column(as_of)}))


def load_all_sources(feeds: Sequence[tuple[DataFrame, FeedMapping]],
                     as_of=None) -> DataFrame:
    """Map every feed, union them, clean the union."""
    return clean_unified(unify_feeds(map_feed(df, m) for df, m in feeds),
                         as_of)


def unify_strict(df: DataFrame, mapping: FeedMapping) -> DataFrame:
    """Strict preparation of one feed.

    Defaults and constants first, then any row with a null among the five
    raw values is dropped, then the timestamp text is parsed (an
    unparsable one stays as a null timestamp, as in the reference order).
    """
    df = _identified(df, mapping)
    c = _mapped(df, mapping)
    raw = df.select(*[c[t].cast("string").alias(t) if t != "amount"
                      else c[t].alias(t) for t in UNIFIED_COLUMNS]).dropna()
    return raw.select(*typed_unified(*[F.col(t) for t in UNIFIED_COLUMNS]))


def unify_permissive(df: DataFrame, mapping: FeedMapping | None,
                     drop_subset=("user_id", "amount", "timestamp")
                     ) -> DataFrame:
    """Headers lower-cased, absent text columns become
    ``missing_<col>``, amount and timestamp are parsed (absent or bad ones
    become null, a typed deviation from the text placeholder), rows null in
    user id, amount or timestamp are dropped.  City may stay null."""
    lowered = df.toDF(*[c.lower() for c in df.columns])
    # a file that already has a column's unified name keeps it
    m = mapping or FeedMapping(PERMISSIVE_UNKNOWN_TAG, columns={
        t: t for t in UNIFIED_COLUMNS if t != "source_id"},
        constants={"source_id": PERMISSIVE_UNKNOWN_TAG})
    m = replace(m, columns={
        t: (*_names(m.columns.get(t, ())), t)
        for t in UNIFIED_COLUMNS if t != "source_id"})
    lowered = _identified(lowered, m)
    c = _mapped(lowered, m, missing_literal=True)
    for t in ("amount", "timestamp"):
        if t not in m.constants and _source(lowered, m.columns.get(t, t)) is None:
            c[t] = F.lit(None).cast("string")
    out = lowered.select(*typed_unified(c["user_id"], c["amount"], c["city"],
                                        c["timestamp"], c["source_id"]))
    return out.dropna(subset=list(drop_subset))


def adapt_schema(df: DataFrame, as_of=None) -> DataFrame:
    """Make an arbitrary upload scoreable.

    Adds ``ingestion_timestamp`` and ``source_id`` (``user_upload``) when
    absent; finds ``amount`` case-insensitively, else renames the first
    numeric column not called id/index/idx (bigint and decimal included,
    a documented widening), else uses the constant -999.0 so accuracy is
    0; adds ``user_id`` and ``city`` as ``unknown`` and ``timestamp`` as
    ``as_of`` when absent.  Decided from the schema alone.
    """
    lower = [c.lower() for c in df.columns]
    now = as_of_column(as_of)
    out = df
    if "ingestion_timestamp" not in lower:
        out = out.withColumn("ingestion_timestamp", now)
    if "source_id" not in lower:
        out = out.withColumn("source_id", F.lit(ADHOC_SOURCE))
    if "amount" in lower:
        original = df.columns[lower.index("amount")]
        if original != "amount":
            out = out.withColumnRenamed(original, "amount")
    else:
        numeric = [c for c, t in df.dtypes
                   if t.startswith(_NUMERIC_PREFIXES)
                   and c.lower() not in ADHOC_ID_NAMES]
        if numeric:
            out = out.withColumnRenamed(numeric[0], "amount")
        else:
            out = out.withColumn("amount", F.lit(ADHOC_NO_AMOUNT).cast("double"))
    for name in ("user_id", "city"):
        if name not in lower:
            out = out.withColumn(name, F.lit(ADHOC_TEXT_DEFAULT))
    if "timestamp" not in lower:
        out = out.withColumn("timestamp", now)
    return out


def feed_counts(df: DataFrame, source_col: str = "source_id") -> DataFrame:
    """Rows per source, ordered by source."""
    return (df.groupBy(source_col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(source_col))


__all__ = ["map_feed", "unify_feeds", "clean_unified", "load_all_sources",
           "unify_strict", "unify_permissive", "adapt_schema", "feed_counts",
           "typed_unified"]
