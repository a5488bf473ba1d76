"""Row numbers and first rows without a task that holds them all.

* Equal rows are numbered by counting: rows are grouped with map-side
  partial counts, and a group of c rows becomes rows 1 to c again, a
  bounded stretch per task.  So a row that a third of a table repeats is
  one counted entry in the shuffle, never one task's load, and the numbers
  are the same however the table is read.
* Rows of files are numbered in two levels: rows of a block, blocks of a
  file, files by path.
* The first n rows by a number are found by narrowing the cutoff with
  counts per range, then taken with a filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import lookup_join, materialize

# Equal rows that one task hands out again; first rows that one merge takes.
STRETCH = 65_536
MERGE_ROWS = 10_000
_RANGES = 4096


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def number_equal_rows(df: DataFrame, out: str) -> DataFrame:
    """Add ``out``: 1 to c over each set of c equal rows (nulls are equal
    to nulls).  Columns must be of types that can be grouped."""
    cols = _quoted(df.columns)
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__c"))
    first = F.lit(1).cast("long")
    few = groups.where(F.col("__c") <= STRETCH).withColumn(
        out, F.explode(F.sequence(first, F.col("__c"))))
    many = (groups.where(F.col("__c") > STRETCH)
            .withColumn("__stretch", F.explode(F.sequence(
                F.lit(0).cast("long"), F.floor((F.col("__c") - 1) / STRETCH))))
            .repartition(F.col("__stretch"), F.xxhash64(*cols))
            .withColumn(out, F.explode(F.sequence(
                F.col("__stretch") * STRETCH + 1, F.least(
                    F.col("__c"), (F.col("__stretch") + 1) * STRETCH)))))
    names = [*cols, F.col(f"`{out}`")]
    return few.select(*names).union(many.select(*names))


def with_row_id(df: DataFrame, out: str) -> DataFrame:
    """Add an id that no other row has and that the row keeps when the
    table is read again: a 128-bit hash of the row and its number among
    equal rows."""
    # a null leaves a hash as it is, so where the nulls are is hashed too
    parts = [p for c in _quoted(df.columns) for p in (c, c.isNull())]
    digest = F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), *parts))),
                               16, "0") for seed in (1, 2)])
    numbered = number_equal_rows(df, "__number")
    return numbered.withColumn(out, F.concat(
        digest, F.lit("-"), F.col("__number").cast("string"))
    ).drop("__number")


def number_file_rows(df: DataFrame, out: str = "row_number") -> DataFrame:
    """Add the row's number, from 0, in the files that ``df`` scans,
    in path order.  ``df`` must be a file scan as it is read (a position is
    taken before anything is filtered); it is stored once, so that the
    blocks that are counted are those that were read."""
    at = df.select("*", F.col("_metadata.file_path").alias("__file"),
                   F.col("_metadata.file_block_start").alias("__block"),
                   F.monotonically_increasing_id().alias("__at"))
    rows = materialize(at)
    # a block lies in one task, so its positions follow each other
    blocks = rows.groupBy("__file", "__block").agg(
        F.min("__at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1)
    inside = blocks.withColumn("before", F.coalesce(
        F.sum("n").over(earlier), F.lit(0)))
    files = blocks.groupBy("__file").agg(F.sum("n").alias("rows"))
    files = files.withColumn("start", F.coalesce(F.sum("rows").over(
        Window.orderBy("__file").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    shift = inside.join(files, "__file").select(
        "__file", "__block", (F.col("start") + F.col("before")
                              - F.col("first")).alias("__shift"))
    return (lookup_join(rows, shift, ["__file", "__block"])
            .withColumn(out, F.col("__at") + F.col("__shift"))
            .select(*_quoted(df.columns), out))


def first_rows(df: DataFrame, by: str, n: int, ties: Sequence[str] = ()
               ) -> DataFrame:
    """The ``n`` rows with the smallest value of the whole-number column
    ``by``; rows equal in it are taken in the order of ``ties``, rows
    without a value not at all.

    Few rows are a top-n.  For many the value of the n-th row is found by
    counts per range, some thousand times narrower each pass, and the rows
    below it are a filter."""
    key = F.col(f"`{by}`")
    rows = df.where(key.isNotNull())
    if n <= MERGE_ROWS:
        return rows.orderBy(key, *_quoted(ties)).limit(n)
    lo, hi, total = rows.agg(F.min(key), F.max(key),
                             F.count(F.lit(1))).first()
    if total <= n:
        return rows
    before = 0
    while True:
        width = -(-(hi - lo + 1) // _RANGES)
        counted = (rows.where((key >= lo) & (key <= hi))
                   .groupBy(F.floor((key - F.lit(lo)) / width).alias("r"))
                   .agg(F.count(F.lit(1)).alias("c")).collect())
        for r in sorted(counted, key=lambda r: r["r"]):
            if before + r["c"] >= n:
                break
            before += r["c"]
        lo, hi = lo + r["r"] * width, min(hi, lo + (r["r"] + 1) * width - 1)
        if width == 1:
            break
    if before + r["c"] == n:
        return rows.where(key <= lo)
    return rows.where(key < lo).union(
        rows.where(key == lo).orderBy(*_quoted(ties)).limit(n - before)
        if ties else rows.where(key == lo).limit(n - before))
