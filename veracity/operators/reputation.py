"""R1-R4 and ST5: how far each source can be trusted, from its outlier rate.

Whole-data reputation is a partial aggregate per source joined back
(R1/R4).  The time-windowed forms never sort a whole source in one task:
records are first reduced to one row per (source, second) or (source,
bucket) with map-side partial aggregation, the trailing window runs over
that reduced table split into time chunks, and the result is joined back
on the (source, second) key, which is fine-grained even when one source
holds most of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lookup import DEFAULT_BROADCAST_BYTES, lookup_join


def epoch_seconds(ts_col: str) -> F.Column:
    """Whole epoch seconds (floor), for plain and NTZ timestamps."""
    return F.col(ts_col).cast("timestamp").cast("long")


def parse_duration(text: str | int) -> int:
    """'1 hour', '10 minutes', '600 seconds', '2 days' or an int -> seconds."""
    if isinstance(text, (int, float)):
        return int(text)
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86400,
             "week": 604800}
    parts = str(text).strip().lower().split()
    total, i = 0, 0
    while i < len(parts):
        n = float(parts[i])
        unit = parts[i + 1].rstrip("s") if i + 1 < len(parts) else "second"
        total += n * units[unit]
        i += 2
    return int(total)


# ---------------------------------------------------------------- R1 / R4
def source_stats(df: DataFrame, source_col: str = "source_id",
                 flag_col: str = "is_anomaly") -> DataFrame:
    """Per source: anomaly_count, total_records (partial + final agg)."""
    return df.groupBy(source_col).agg(
        F.sum(F.col(flag_col).cast("int")).alias("anomaly_count"),
        F.count(F.lit(1)).alias("total_records"))


def compute_source_reputation(df: DataFrame, source_col: str = "source_id",
                              flag_col: str = "is_anomaly",
                              empty_value: float | None = None,
                              max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES
                              ) -> DataFrame:
    """reputation = 1 - anomalies / records, per source over all rows.

    Left join back on the source; a null source matches nothing, so its
    reputation is null.  ``empty_value`` is R4's value for an empty
    group (0.5 there), which a group that exists never is.
    """
    stats = source_stats(df, source_col, flag_col)
    rep = 1.0 - F.col("anomaly_count") / F.col("total_records")
    if empty_value is not None:
        rep = F.when(F.col("total_records") > 0, rep).otherwise(
            F.lit(float(empty_value)))
    lookup = stats.select(source_col, rep.alias("source_reputation"))
    return lookup_join(df, lookup, [source_col], how="left",
                       max_broadcast_bytes=max_broadcast_bytes)


def compute_source_reputation_batch_reference(df: DataFrame, **kw
                                              ) -> DataFrame:
    """R1 with 0.5 for an empty group."""
    return compute_source_reputation(df, empty_value=0.5, **kw)


# ---------------------------------------------------------------- R2 / R3
def _trailing_counts(df: DataFrame, window_seconds: int, source_col: str,
                     flag_col: str, ts_col: str, chunk_seconds: int
                     ) -> DataFrame:
    """(source, __sec, __wa, __wn): anomalies and rows in [sec-W, sec].

    Records are reduced to one row per (source, second) first.  A second
    enters the sums at its own time and leaves them W + 1 later, so the
    sums at a time are those of all moves up to it: a running sum, whose
    work does not grow with the rows that a window holds.  It runs per
    (source, time chunk); what a chunk can still see of the chunks before
    it enters at its start as one row.
    """
    W = int(window_seconds)
    sec = epoch_seconds(ts_col)
    flag = F.col(flag_col).cast("int")
    C = int(chunk_seconds)
    per_sec = (df.select(source_col, sec.alias("__sec"), flag.alias("__a"))
               .groupBy(source_col, "__sec")
               .agg(F.sum("__a").alias("__a"), F.count("__a").alias("__f"),
                    F.count(F.lit(1)).alias("__n")))
    sec, gone = F.col("__sec"), F.col("__sec") + W + 1
    home, reach = F.floor(sec / C), F.floor((sec + W) / C)
    sums = [F.col("__a"), F.col("__f"), F.col("__n")]
    # null seconds are in a frame of their own: no chunk, no other move
    enter = per_sec.select(source_col, "__sec", home.alias("__chunk"),
                           sec.alias("__at"), *sums)
    none = F.lit(None).cast("long").alias("__sec")
    # beyond the reach nothing has entered that could leave
    leave = per_sec.where(F.floor(gone / C) == reach).select(
        source_col, none, reach.alias("__chunk"), gone.alias("__at"),
        *[(-c).alias(f"__{k}") for c, k in zip(sums, "afn")])
    start = (per_sec.where(reach > home)
             .withColumn("__chunk", F.explode(F.sequence(home + 1, reach)))
             .groupBy(source_col, "__chunk")
             .agg(*[F.sum(c).alias(f"__{k}") for c, k in zip(sums, "afn")])
             .select(source_col, none, "__chunk",
                     (F.col("__chunk") * C).alias("__at"), *sums))
    moves = (enter.withColumn("__own", F.lit(True))
             .unionByName(leave.withColumn("__own", F.lit(False)))
             .unionByName(start.withColumn("__own", F.lit(False))))
    w = (Window.partitionBy(source_col, "__chunk").orderBy("__at")
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))

    def running(c: str) -> F.Column:
        return F.sum(c).over(w)

    return (moves
            .select(source_col, "__sec", "__own",
                    F.when(running("__f") > 0, running("__a")).alias("__wa"),
                    running("__n").alias("__wn"))
            .where("__own")
            .select(source_col, "__sec", "__wa", "__wn"))


def compute_source_reputation_streaming(
        df: DataFrame, window_duration: str | int = "1 hour",
        sliding_duration: str | int = "10 minutes", *,
        source_col: str = "source_id", flag_col: str = "is_anomaly",
        ts_col: str = "timestamp",
        chunk_seconds: int = 86_400,
        max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """R2: trailing-window reputation per source, range [t - W, t] seconds.

    Peers in the same second are counted; a null timestamp forms its own
    frame with the other null timestamps of the source.  On a bounded
    frame this is the record-exact form; streams use the sliding or the
    state-based forms in ``veracity.streaming``.  ``sliding_duration`` is
    used by ``compute_sliding_reputation``.
    """
    W = parse_duration(window_duration)
    counts = _trailing_counts(df, W, source_col, flag_col, ts_col,
                              chunk_seconds)
    rep = F.when(F.col("__wn") > 0, 1.0 - F.col("__wa") / F.col("__wn")
                 ).otherwise(0.5)
    lookup = counts.select(source_col, "__sec",
                           F.col("__wa").cast("long").alias("anomalies_in_window"),
                           F.col("__wn").cast("long").alias("total_in_window"),
                           rep.alias("source_reputation"))
    keyed = df.withColumn("__sec", epoch_seconds(ts_col))
    return lookup_join(keyed, lookup, [source_col, "__sec"], null_safe=True,
                       max_broadcast_bytes=max_broadcast_bytes).drop("__sec")


def compute_source_reputation_recent(df: DataFrame, seconds: int = 600,
                                     **kw) -> DataFrame:
    """R3 as coded: 1 - anomaly rate of the trailing ``seconds``."""
    out = compute_source_reputation_streaming(df, seconds, **kw)
    return (out.withColumn("recent_anomaly_rate",
                           F.col("anomalies_in_window") / F.col("total_in_window"))
            .drop("anomalies_in_window", "total_in_window")
            .withColumn("source_reputation", 1.0 - F.col("recent_anomaly_rate")))


# ---------------------------------------------------------------- ST5
def compute_sliding_reputation(df: DataFrame, window_duration="1 hour",
                               sliding_duration="10 minutes", *,
                               source_col: str = "source_id",
                               flag_col: str = "is_anomaly",
                               ts_col: str = "timestamp",
                               max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES
                               ) -> DataFrame:
    """ST5 on a bounded frame: hopping windows W / slide per source.

    Each record takes the window that ends at the first slide boundary
    after it, [end - W, end); the same value the streaming form joins in.
    Records are reduced per (source, slide bucket), each bucket feeds the
    W/slide windows that contain it, and windows are summed per (source,
    end) before the join back.
    """
    W = parse_duration(window_duration)
    S = parse_duration(sliding_duration)
    if W % S:
        raise ValueError("window must be a multiple of the slide")
    k = W // S
    bucket = F.floor(epoch_seconds(ts_col) / S)
    per_bucket = (df.select(source_col, bucket.alias("__b"),
                            F.col(flag_col).cast("int").alias("__a"))
                  .where(F.col("__b").isNotNull())
                  .groupBy(source_col, "__b")
                  .agg(F.sum("__a").alias("__a"), F.count(F.lit(1)).alias("__n")))
    windows = (per_bucket
               .withColumn("__end_b", F.explode(
                   F.sequence(F.col("__b") + 1, F.col("__b") + k)))
               .groupBy(source_col, "__end_b")
               .agg(F.sum("__a").alias("anomalies_in_window"),
                    F.sum("__n").alias("total_in_window")))
    lookup = windows.select(
        source_col, F.col("__end_b").alias("__eb"),
        F.timestamp_seconds((F.col("__end_b") - k) * S).alias("window_start"),
        F.timestamp_seconds(F.col("__end_b") * S).alias("window_end"),
        "anomalies_in_window", "total_in_window",
        (1.0 - F.col("anomalies_in_window") / F.col("total_in_window"))
        .alias("source_reputation"))
    keyed = df.withColumn("__eb", bucket + 1)
    return lookup_join(keyed, lookup, [source_col, "__eb"], null_safe=True,
                       max_broadcast_bytes=max_broadcast_bytes).drop("__eb")


# ---------------------------------------------------------------- EMA
# Powers of the weights stay within a double's range in a chunk.
_EMA_DIGITS, _EMA_CHUNK = 280.0, 1024


def _ema_chunk(alpha: float, most: int) -> int:
    """Buckets of a chunk: (1 - alpha)^-chunk is still a number."""
    return max(1, min(most, int(
        _EMA_DIGITS / -math.log10(1.0 - alpha))))


def compute_source_reputation_exponential_moving_average(
        df: DataFrame, alpha: float = 0.3, bucket_duration="10 minutes", *,
        source_col: str = "source_id", flag_col: str = "is_anomaly",
        ts_col: str = "timestamp", chunk_buckets: int = _EMA_CHUNK,
        max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """R3 as documented: exponentially smoothed anomaly rate per source.

    rate_b = anomalies / rows of time bucket b; ema_1 = rate_1,
    ema_b = alpha * rate_b + (1 - alpha) * ema_(b-1) over the source's
    non-empty buckets in time order; reputation = 1 - ema of the record's
    bucket.  Records are first reduced per (source, bucket).

    The recurrence is linear: with q = 1 - alpha the k-th value of a time
    chunk is q^k in + q^k sum(alpha rate_j q^-j), a prefix sum in a window
    of one chunk.  What comes into a chunk is folded over the source's
    chunks, a row each.  Null timestamps get a null reputation.
    """
    S = parse_duration(bucket_duration)
    a = float(alpha)
    if not 0.0 < a <= 1.0:
        raise ValueError("alpha must be above 0 and at most 1")
    q = F.lit(1.0 - a)
    bucket = F.floor(epoch_seconds(ts_col) / S)
    rates = (df.select(F.col(source_col).alias("__src"), bucket.alias("__b"),
                       F.col(flag_col).cast("int").alias("__a"))
             .where(F.col("__b").isNotNull())
             .groupBy("__src", "__b")
             .agg((F.sum("__a") / F.count(F.lit(1))).alias("__rate")))
    if a == 1.0:
        smooth = rates.select("__src", "__b", F.col("__rate").alias("__ema"))
    else:
        chunk = F.floor(F.col("__b") / _ema_chunk(a, chunk_buckets))
        w = Window.partitionBy("__src", "__chunk").orderBy("__b")
        k = F.col("__k")
        # read twice below: the exchange of the rates is reused
        local = (rates.withColumn("__chunk", chunk)
                 .withColumn("__k", F.row_number().over(w))
                 .withColumn("__own", F.pow(q, k) * F.sum(
                     F.col("__rate") * a * F.pow(q, -k)).over(w)))
        chunks = local.groupBy("__src", "__chunk").agg(
            F.max_by("__own", "__k").alias("end"), F.max("__k").alias("n"),
            F.min_by("__rate", "__k").alias("first"))
        # a source's first value stands for what comes into its first chunk
        listed = chunks.groupBy("__src").agg(F.sort_array(F.collect_list(
            F.struct("__chunk", "end", "n", "first"))).alias("cs"))
        start = F.struct(
            F.element_at("cs", 1)["first"].alias("value"),
            F.array().cast("array<double>").alias("into"))
        into = F.aggregate("cs", start, lambda s, c: F.struct(
            (c["end"] + F.pow(q, c["n"]) * s["value"]).alias("value"),
            F.concat(s["into"], F.array(s["value"])).alias("into")))["into"]
        into = listed.select("__src", F.explode(F.arrays_zip(
            F.col("cs.__chunk").alias("__chunk"), into.alias("__in"))
            ).alias("z")).select(F.col("__src").alias("__s"),
                                 F.col("z.__chunk").alias("__c"), "z.__in")
        smooth = local.join(into, F.col("__src").eqNullSafe(F.col("__s"))
                            & (F.col("__chunk") == F.col("__c"))).select(
            "__src", "__b", (F.col("__own") + F.pow(q, k) * F.col("__in"))
            .alias("__ema"))
    lookup = smooth.select(
        F.col("__src").alias(source_col), "__b",
        F.col("__ema").alias("ema_anomaly_rate"),
        (1.0 - F.col("__ema")).alias("source_reputation"))
    keyed = df.withColumn("__b", bucket)
    return lookup_join(keyed, lookup, [source_col, "__b"], null_safe=True,
                       max_broadcast_bytes=max_broadcast_bytes).drop("__b")


__all__ = [
    "compute_source_reputation", "compute_source_reputation_batch_reference",
    "compute_source_reputation_streaming", "compute_source_reputation_recent",
    "compute_sliding_reputation",
    "compute_source_reputation_exponential_moving_average",
    "source_stats", "epoch_seconds", "parse_duration",
]
