"""The corpus pipeline: reject, deduplicate, decontaminate, mix, shard.

Each stage takes the documents that its predecessor kept and returns
documents; the last one returns the shuffled shards.  ``run`` writes what
a stage returns as Parquet in the shared scratch folder and reads it back
for the next, so a lost executor or a failed stage costs that stage only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veracity.llm import common, decontam, minhash, mixing, sharding, toxicity
from veracity.session import delete_path, scratch_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str
                 ) -> DataFrame:
    """Documents that the toxicity score doesn't reject.  Labels teach the
    score only where they aren't held out."""
    labels = common.read_table(spark, sf_dir, "labels")
    return toxicity.reject_toxic(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str
                     ) -> DataFrame:
    """One document of each group of near copies: shingles of five words
    (the rule for stages; two words would link more), similarity 0.8 or
    more."""
    return minhash.deduplicate(docs, minhash.MinHashParams(shingle=5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str
                      ) -> DataFrame:
    """Documents of whose words less than 5 % lie in benchmark passages."""
    return decontam.decontaminate(
        docs, common.read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str
                ) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mix(docs).drop("__position")


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str
               ) -> DataFrame:
    """The mixed documents with their shard and their slot in it."""
    rows = sharding.shard(docs)
    return rows.withColumnsRenamed({"__shard": "shard", "__slot": "slot"})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str],
                                 DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_rows),
]

# Learnt scores and minhashes are no SQL; tests compare the stages with
# brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``: its columns, shard
    and slot."""
    docs, before = common.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        rows = stage(spark, docs, sf_dir)
        rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if before:      # written and read: its predecessor isn't needed
            delete_path(spark, before)
        before = path
    return docs
