"""Helpers shared by the operators: scratch tables, words, prefix sums.

Words are found on UTF-8 bytes with numpy, a block of text at a time, so
a very long text costs a few arrays of one block plus one hash per word.
A word's hash is a polynomial over random byte values, taken from prefix
sums and finished with a mixing step; 64 bits stand for the word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import delete_path, ensure_checkpoint_dir, scratch_path

U64 = np.uint64
BLOCK = 1 << 19
# Spark's class of word characters for the space-separated contract.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Words separated by space and \t \n \v \f \r.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False
# Words of ASCII letters and digits and of everything beyond ASCII.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True

_BYTE = np.random.default_rng(20240).integers(
    0, 2 ** 64, size=256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2 ** 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * BLOCK:
            _POWERS[base] = have
    return have[:n]


def _cut(data: np.ndarray, offsets: np.ndarray, word: np.ndarray,
         lo: int) -> int:
    """End of the block that starts at ``lo``: never inside a word."""
    end = int(offsets[-1])
    hi = lo + BLOCK
    if hi >= end:
        return end
    k = int(np.searchsorted(offsets, hi, "right")) - 1
    best = int(offsets[k]) if offsets[k] > lo else lo
    gaps = np.flatnonzero(~word[data[max(best, lo):hi]])
    if len(gaps):
        best = max(best, max(best, lo) + int(gaps[-1]) + 1)
    if best > lo:
        return best
    stop = int(offsets[np.searchsorted(offsets, lo, "right")])
    while hi < stop:            # one word longer than a block
        gaps = np.flatnonzero(~word[data[hi:min(hi + BLOCK, stop)]])
        if len(gaps):
            return hi + int(gaps[0]) + 1
        hi = min(hi + BLOCK, stop)
    return stop


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts, and where each text's begin.

    ``data`` holds the texts' bytes one after the other, ``offsets`` (one
    more than texts) their borders; ``word`` tells the bytes of a word
    after A-Z is lower-cased.  Returns all hashes in order and, per text
    border, the number of words before it.
    """
    offsets = np.asarray(offsets, dtype=np.int64)
    low = word[_LOWER]
    hashes, starts_all = [], []
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = _cut(data, offsets, low, lo)
        b = data[lo:hi]
        inside = low[b]
        first = np.empty(hi - lo + 1, dtype=bool)   # a text begins here
        first[:] = False
        i, j = np.searchsorted(offsets, [lo, hi], "left")
        first[offsets[i:j + 1][offsets[i:j + 1] <= hi] - lo] = True
        before = np.empty(hi - lo, dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty(hi - lo, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        s = np.flatnonzero(inside & (~before | first[:-1]))
        e = np.flatnonzero(inside & (~after | first[1:])) + 1
        sums = np.empty(hi - lo + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[_LOWER[b]] * _powers(_BASE, hi - lo), out=sums[1:])
        h = (sums[e] - sums[s]) * _powers(_BASE_INV, hi - lo)[s]
        hashes.append(mix(h + (e - s).astype(np.uint64)))
        starts_all.append(s + lo)
        lo = hi
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offsets, "left")


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a binary Arrow column; a null has no bytes."""
    n = len(column)
    wide = pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32,
                            count=n + 1 + column.offset)[column.offset:]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8), offsets.astype(np.int64)


def row_chunks(offsets: np.ndarray, limit: int = 1 << 20
               ) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``limit`` bytes (one row at least)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def shingles(h: np.ndarray, border: np.ndarray, width: int
             ) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, with borders.

    A text with fewer words than ``width`` has its whole word sequence as
    its only shingle; one without words has none.
    """
    n_words = np.diff(border)
    rows = len(n_words)
    if not len(h):
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    step = _powers(0xD6E8FEB86659FD93, width)
    sh = h.copy()
    for k in range(1, min(width, len(h))):
        sh[:len(h) - k] += h[k:] * step[k]
    sh = mix(sh)
    row = np.repeat(np.arange(rows), n_words)
    last = border[1:][row] - np.arange(len(h)) >= width
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    extra = np.empty(len(short), np.uint64)
    for i, r in enumerate(short):
        w = h[border[r]:border[r + 1]]
        extra[i] = mix((w * step[:len(w)]).sum(dtype=np.uint64)
                       + U64(0x51ED27 + len(w)))
    sh = np.concatenate([sh[last], extra])
    row = np.concatenate([row[last], short])
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    sh, row = sh[new], row[new]
    return sh, np.searchsorted(row, np.arange(rows + 1), "left")


# --- tables -------------------------------------------------------------

@contextmanager
def text_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Arrow batches of about ``size`` bytes for the Python stages that run
    inside: whole texts are long, and a batch is held by the JVM and by
    Python at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def own_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the named columns under the operator's own names, so that extra
    columns of the input never clash."""
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])


_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end; the result is one saved
    after it (by then nothing lazy may refer to them)."""
    token = _TABLES.set([])
    try:
        yield
    finally:
        for path in _TABLES.get():
            delete_path(spark, path)
        _TABLES.reset(token)


def result_of(make: Callable[[], DataFrame], spark: SparkSession, name: str
              ) -> DataFrame:
    """Run ``make`` with Arrow batches for long texts, save what it returns
    and delete the tables it saved on the way."""
    path = scratch_path(spark, name)
    with scratch_tables(spark), text_batches(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
    if _TABLES.get() is not None:       # a step of a larger operator
        _TABLES.get().append(path)
    return spark.read.schema(schema).parquet(path)


def save(df: DataFrame, name: str, compression: str = "snappy"
         ) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage is cut and
    a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    if _TABLES.get() is not None:
        _TABLES.get().append(path)
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder (removed with its last reference)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def semi_join(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (distinct).  ``ids`` is
    broadcast only when its counted rows fit the bound; a shuffle join
    does the same beyond it."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_semi")


def without_texts(docs: DataFrame, judge: Callable[[DataFrame], DataFrame],
                  text_col: str) -> DataFrame:
    """``docs`` without the rows whose text is judged bad.

    ``judge`` takes (doc_id, text) and returns the bad rows' doc_id, which
    is a 64-bit hash of the text here: a verdict that follows from the
    text alone reaches the rows with that text and no others."""
    text = F.col(f"`{text_col}`").cast("string")
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    bad = cut(judge(docs.select(key.alias("doc_id"), text.alias("text")))
              .select(F.col("doc_id").alias("__bad")).distinct())
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, key == F.col("__bad"), "left_anti")


def code_order(col: Column) -> Column:
    """Order by code point, null last (UTF-8 bytes order like code points)."""
    return col.asc_nulls_last()


def hash_buckets(rows: int) -> int:
    """Buckets for a two-level prefix sum: both a bucket's rows and the
    number of buckets grow with the square root of the rows."""
    return max(1, int(round(rows ** 0.5)))


def prefix_sums(df: DataFrame, group: list[str], bucket: str,
                order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same group.

    Rows are ordered by (``bucket``, ``order``) within ``group``.  A window
    only ever holds one bucket of a group; the buckets' totals, one row
    each, give the offset of a bucket.
    """
    key = [*group, bucket]
    totals = df.groupBy(*key).agg(F.sum(value).alias("__sum"))
    w = (Window.partitionBy(*group) if group else Window.partitionBy(
        F.lit(0))).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn(
        "__before", F.coalesce(F.sum("__sum").over(w), F.lit(0)))
    totals = totals.select(*[F.col(k).alias(f"__{k}") for k in key],
                           "__before")
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    wr = Window.partitionBy(*key).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    inner = df.withColumn(out, F.coalesce(F.sum(value).over(wr), F.lit(0)))
    return (inner.join(totals, cond)
            .withColumn(out, F.col(out) + F.col("__before"))
            .drop("__before", *[f"__{k}" for k in key]))


def unfold(df: DataFrame, first: Column, last: Column, out: str,
           stretch: int = 65_536) -> DataFrame:
    """A row for each whole number from ``first`` to ``last``; a long range
    comes out of many tasks, a stretch each."""
    rows = df.withColumns({"__lo": first.cast("long"),
                           "__hi": last.cast("long")})
    long = F.col("__hi") - F.col("__lo") >= stretch
    parts = rows.where(long).withColumn("__at", F.explode(F.sequence(
        F.lit(0).cast("long"),
        F.floor((F.col("__hi") - F.col("__lo")) / stretch))))
    parts = parts.repartition("__at", "__lo", "__hi").withColumns({
        "__lo": F.col("__lo") + F.col("__at") * stretch,
        "__hi": F.least(F.col("__hi"), F.col("__lo") + F.col("__at")
                        * stretch + stretch - 1)}).drop("__at")
    return rows.where(~long).unionByName(parts).withColumn(
        out, F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


# --- connected components ------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the edges (a, b): component is the
    smallest id reachable.

    Alternates the two star steps: every node hangs its larger neighbours
    on its smallest neighbour, then every node hangs its smaller
    neighbours on the smallest.  Each step is a minimum per node (with
    partial aggregation) and a join back that AQE can split, so a node
    with very many links is no single group.  Only a count and a sum per
    round reach the driver.
    """
    a, b = F.col("a"), F.col("b")
    e = cut(edges.where(a != b).select(F.greatest(a, b).alias("a"),
                                       F.least(a, b).alias("b")).distinct())
    mark = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(
            F.least(F.min("b"), a).alias("m"))
        large = (both.where(b > a).join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where(a != b).distinct())
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low2, "a")
                 .select(F.when(b == F.col("m"), a).otherwise(b).alias("a"),
                         F.col("m").alias("b")).where(a != b).distinct())
        e = cut(small)
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast(
            "decimal(38,0)"))).first()
        if tuple(r) == mark:
            break
        mark = tuple(r)
    found = e.select(a.alias("id"), b.alias("component"))
    return found.union(e.select(b, b).distinct())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
