"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters every record by seeded hashes: its shard is the one
with the highest hash of (doc_id, shard), so doc_id and the number of
shards decide it and one more shard only takes rows into itself; within
the shard a second hash picks one of the memory-sized buckets.  Pass two
puts each bucket through a Fisher-Yates shuffle whose draws are hashes of
(seed, bucket, step), so a task that runs again writes the same order,
and writes it.  A record's slot is the records of its shard's earlier
buckets plus its place in its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from ..session import scratch_path


@dataclass(frozen=True)
class ShardParams:
    """``bucket_bytes`` and ``bucket_rows`` size a bucket: the number of
    buckets follows from the table, so that on average neither is passed."""

    shards: int = 16
    bucket_bytes: int = 1 << 20
    bucket_rows: int = 256
    seed: int = 5


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest seeded hash (the first of equal ones)."""
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"),
                           (-s).alias("s")))
    return -F.array_max(scores)["s"]


def fisher_yates(n: Column, bucket: Column, seed: int) -> Column:
    """A permutation of 0 .. n-1: from the last place down, each place is
    swapped with one drawn from those up to it."""
    def swap(a, i):
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        x, y = F.get(a, i), F.get(a, j)
        return F.transform(a, lambda v, k: F.when(k == i, y).when(
            k == j, x).otherwise(v))
    start = F.sequence(F.lit(0), n - 1)
    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(steps, start, swap)


def write_shards(docs: DataFrame, path: str,
                 params: ShardParams = ShardParams(),
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as shuffled shards: folders ``__shard=N`` under
    ``path``, all columns kept, plus ``__bucket`` and ``__place`` (the
    order within the shard).

    A null id hashes like any other value; null texts count no bytes.
    Rows that repeat an id share its shard; rows that repeat id and text
    more often than a bucket holds are dealt to several buckets by their
    row number (a scan gives it again when a task is repeated).  An empty
    table writes no rows.  Columns of the input whose names start with
    ``__`` and clash with the written ones are refused by Spark.
    """
    p = params
    key, text = F.col(id_col), F.col(text_col).cast("binary")
    crc = F.crc32(text)
    same = docs.select(
        key.alias("__k"), crc.alias("__c"), F.coalesce(F.octet_length(
            F.col(text_col)), F.lit(0)).alias("b")).groupBy(
        "__k", "__c").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    same = C.cut(same)
    total = same.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    often = same.where(F.col("n") > p.bucket_rows).select(
        "__k", "__c", F.ceil(F.col("n") / p.bucket_rows).alias("__parts"))
    per_shard = max(1, -(-(total["n"] or 0) // (p.bucket_rows * p.shards)),
                    -(-(total["b"] or 0) // (p.bucket_bytes * p.shards)))
    part = F.lit(0).cast("long")
    columns = docs.columns
    if not often.isEmpty():
        if often.count() <= C.BROADCAST_ROWS:   # else a shuffle join
            often = F.broadcast(often)
        docs = docs.withColumn("__row", F.monotonically_increasing_id()).join(
            often, key.eqNullSafe(F.col("__k"))
            & crc.eqNullSafe(F.col("__c")), "left")
        part = F.coalesce(F.pmod("__row", "__parts"), part)
    sub = F.pmod(F.xxhash64(F.lit(p.seed + 1), key, crc, part),
                 F.lit(per_shard))
    rows = docs.select(
        shard_of(key, p.shards, p.seed).alias("__shard"),
        sub.alias("__bucket"), F.struct(
            F.xxhash64(F.lit(p.seed + 2), key, crc).alias("h"),
            F.struct(*columns).alias("row")).alias("item"))
    bucket = rows.groupBy("__shard", "__bucket").agg(
        F.collect_list("item").alias("items"))
    # a fixed order first: the shuffle then depends on the rows alone
    by_hash = F.array_sort("items", lambda x, y: F.when(
        x["h"] < y["h"], -1).when(x["h"] > y["h"], 1).otherwise(0))
    bucket = bucket.withColumn("items", by_hash)
    perm = fisher_yates(F.size("items"), F.xxhash64("__shard", "__bucket"),
                        p.seed + 3)
    out = bucket.select("__shard", "__bucket", "items", perm.alias("perm"))
    out = out.select("__shard", "__bucket", "items",
                     F.posexplode("perm").alias("__place", "at"))
    out = out.select("__shard", "__bucket", "__place", F.expr(
        "get(items, at).row").alias("row"))
    out.select("__shard", "__bucket", "__place", "row.*").write.partitionBy(
        "__shard").parquet(path)


def read_shards(docs: DataFrame, path: str, columns=None) -> DataFrame:
    """The written shards: the columns of ``docs`` (or the given
    ``columns``, which may be expressions of them), ``__shard`` and
    ``__slot``, gapless from 0 in each shard."""
    spark = docs.sparkSession
    schema = T.StructType([*docs.schema.fields,
                           T.StructField("__bucket", T.LongType()),
                           T.StructField("__place", T.IntegerType()),
                           T.StructField("__shard", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(path)
    w = Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    before = C.cut(rows.groupBy("__shard", "__bucket").agg(
        F.count("*").alias("c")).select(
        "__shard", "__bucket",
        F.coalesce(F.sum("c").over(w), F.lit(0)).alias("__before")))
    if before.count() <= C.BROADCAST_ROWS:  # else a shuffle join
        before = F.broadcast(before)
    rows = rows.select(*(columns or docs.columns), "__shard", "__bucket",
                       "__place")
    return (rows.join(before, ["__shard", "__bucket"])
            .withColumn("__slot", F.col("__before") + F.col("__place"))
            .drop("__before", "__bucket", "__place"))


def shard(docs: DataFrame, params: ShardParams = ShardParams(),
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to the shared scratch folder and read them back."""
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(docs, path, params, id_col, text_col)
    return read_shards(docs, path)


def shard_table(docs: DataFrame, params: ShardParams = ShardParams(),
                id_col: str = "doc_id", text_col: str = "text"
                ) -> DataFrame:
    """One row per record, read back from the shards: doc_id, size,
    text_crc32, law, shard, slot and the shard it would have with one more
    (the same, or the new one)."""
    p = params
    own = docs.select(F.col(id_col).alias("doc_id"),
                      F.col(text_col).alias("text"))
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(own, path, p)
    # what is reported of a text is taken before rows meet their buckets
    rows = read_shards(own, path, [
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
        .alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
        .alias("text_crc32")])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").cast("long").alias("slot"),
        shard_of(F.col("doc_id"), p.shards + 1, p.seed)
        .alias("grown_shard"))
