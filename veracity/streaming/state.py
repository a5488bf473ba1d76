"""ST6: exact trailing-window reputation on a stream.

Records are counted per (source, second) by a windowed aggregate, which
hands out a second once the watermark has passed it.  Keyed state per
source holds nothing but the counts of the last ``window`` seconds, in
chunks of some minutes, adds up each new second's trailing window, and
expires by a timer when the source falls silent.  The sums, copied ``salts``
times, are joined back to the records on (source, second, salt) by a
stream-stream join, so records keep their types, never pass through the
keyed state, and a source with most of the records is spread over
``salts`` join partitions.  The result equals the batch form R2 on the
same rows; records behind the watermark on arrival are dropped, as
Spark's own stateful operators do.

The keyed step is Spark's ``transformWithState``, the stateful operator
that may stand between other ones; it needs the RocksDB state store
(``rocksdb_state``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = ("org.apache.spark.sql.execution.streaming.state."
           "RocksDBStateStoreProvider")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The state store that queries started inside will use."""
    old = spark.conf.get(PROVIDER_KEY)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER_KEY, old)


# Seconds of one entry of a source's state.
CHUNK_SECONDS = 600


class TrailingSums(StatefulProcessor):
    """Per source: rows and anomalies of the seconds in [t - W, t].

    The state is a map of time chunks to the counts of their seconds: a
    batch rewrites the chunks it touches and removes those that no window
    reaches any more.  A timer a window after the source's last second
    clears what is left, so a source that has gone silent holds nothing.
    """

    def __init__(self, window_seconds: int):
        self.window = int(window_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState(
            "counts", "chunk long",
            "sec array<long>, n array<long>, a array<long>")

    def _held(self) -> dict[int, tuple]:
        return {int(k[0]): v for k, v in self.counts.iterator()}

    def handleInputRows(self, key, rows, timerValues
                        ) -> Iterator[pd.DataFrame]:
        # the aggregate hands out seconds in the watermark's order, so all
        # earlier seconds of the source have been here
        new = pd.concat(list(rows)).sort_values("sec")
        held = self._held()
        old = [held[c] for c in sorted(held)]
        sec, n, a = (np.concatenate(
            [*[np.array(v[i], np.int64) for v in old],
             new[c].to_numpy(np.int64)]) for i, c in enumerate(
                 ("sec", "n", "a")))
        sum_n, sum_a = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(a)]
        t = new["sec"].to_numpy(np.int64)
        lo = np.searchsorted(sec, t - self.window, "left")
        hi = np.searchsorted(sec, t, "right")
        yield pd.DataFrame({
            "src": [key[0]] * len(t), "second": new["second"].to_numpy(),
            "wa": sum_a[hi] - sum_a[lo], "wn": sum_n[hi] - sum_n[lo]})
        last = int(sec[-1])
        chunk = sec // CHUNK_SECONDS
        alive = (last - self.window) // CHUNK_SECONDS
        for c in held:
            if c < alive:
                self.counts.removeKey((c,))
        for c in np.unique(t // CHUNK_SECONDS):
            if c >= alive:
                here = chunk == c
                self.counts.updateValue((int(c),), (
                    sec[here].tolist(), n[here].tolist(), a[here].tolist()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.window + 1) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo
                           ) -> Iterator[pd.DataFrame]:
        # seconds to come are not before the watermark: no window of theirs
        # reaches back to what is held
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def exact_stream_reputation(df: DataFrame, window_seconds: int = 3600,
                            source_col: str = "source_id",
                            flag_col: str = "is_anomaly",
                            ts_col: str = "timestamp", salts: int = 4
                            ) -> DataFrame:
    """Per-record trailing-window reputation of a watermarked stream.

    A null source is a source of its own.  Rows without a timestamp cannot
    be placed: they pass at once with a null reputation.
    """
    placed = df.where(F.col(ts_col).isNotNull()).withColumn(
        "__src", F.coalesce(F.concat(F.lit("="), F.col(source_col)),
                            F.lit("")))
    second = F.window(ts_col, "1 second")
    per = placed.groupBy(second.alias("w"), F.col("__src").alias("src")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(flag_col).cast("long")).alias("a"))
    per = per.select("src", F.window_time("w").alias("second"),
                     F.col("w.start").cast("long").alias("sec"), "n", "a")
    sums = per.groupBy("src").transformWithStateInPandas(
        TrailingSums(window_seconds),
        "src string, second timestamp, wa long, wn long", "Append",
        "EventTime", eventTimeColumnName="second")
    sums = sums.withColumn("salt", F.explode(F.sequence(
        F.lit(0), F.lit(salts - 1))))
    recs = (placed.withColumn("__salt", F.pmod(
                F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
            .withColumn("__w", second)
            .withColumn("__second", F.window_time("__w"))
            .withColumn("__t", F.unix_micros(F.col(ts_col).cast("timestamp")))
            .drop("__w", ts_col))
    joined = recs.join(sums, (recs["__second"] == sums["second"])
                       & (recs["__src"] == sums["src"])
                       & (recs["__salt"] == sums["salt"]), "inner")
    counts = {"anomalies_in_window": "wa", "total_in_window": "wn"}
    joined = joined.select(
        *[F.timestamp_micros("__t").alias(c) if c == ts_col else recs[c]
          for c in df.columns],
        *[F.col(v).alias(k) for k, v in counts.items()],
        (1.0 - F.col("wa") / F.col("wn")).alias("source_reputation"))
    rest = df.where(F.col(ts_col).isNull()).select(
        *df.columns, *[F.lit(None).cast("long").alias(k) for k in counts],
        F.lit(None).cast("double").alias("source_reputation"))
    return joined.unionByName(rest)
