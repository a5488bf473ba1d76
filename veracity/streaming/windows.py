"""ST3: window results in update and complete mode, kept as a table.

A file sink takes append mode only.  Here a micro-batch's window results
go into a keyed table:

* ``update``: the batch's changed rows are stored as one layer, in one
  rename; the table is the base with the layers' latest row per key.
  Every ``compact_every`` batches the layers are merged into a new base,
  a generation of a versioned folder, so a read never holds many layers.
* ``complete``: the batch is the whole result and replaces the table.

Both are idempotent by batch id: a repeated batch finds its layer or its
table there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import publish


def _layers(spark: SparkSession, path: str, through: int) -> list[int]:
    ids = [int(n.split("=")[1]) for n in publish.names(
        spark, f"{path}/layers") if n.startswith("batch=")]
    return sorted(i for i in ids if i > through)


def read_latest(spark: SparkSession, path: str, schema,
                keys: Sequence[str]) -> DataFrame:
    """The table: per key the row of its latest batch."""
    base = publish.current_generation(spark, f"{path}/base")
    through = base[1]["through"] if base else -1
    names = list(schema.names)
    rows = spark.createDataFrame([], schema).withColumn(
        "__batch", F.lit(-1).cast("long"))
    if base:
        rows = spark.read.schema(schema).parquet(base[0]).withColumn(
            "__batch", F.lit(through).cast("long"))
    for i in _layers(spark, path, through):
        rows = rows.unionByName(spark.read.schema(schema).parquet(
            f"{path}/layers/batch={i}").withColumn(
                "__batch", F.lit(i).cast("long")))
    values = [c for c in names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(
        F.struct(*values), "__batch").alias("v"))
    return last.select(*keys, *[F.col(f"v.`{c}`").alias(c) for c in values]
                       ).select(*names)


def _consume(batch: DataFrame) -> None:
    """Run a repeated batch without keeping its rows: the state store of
    the aggregate commits only what is run."""
    batch.write.format("noop").mode("overwrite").save()


def _update(spark: SparkSession, path: str, schema, keys: Sequence[str],
            compact_every: int):
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        base = publish.current_generation(spark, f"{path}/base")
        layer = f"{path}/layers/batch={batch_id}"
        if base and batch_id <= base[1]["through"]:
            return _consume(batch)      # repeated, and merged already
        if publish.exists(spark, layer):
            _consume(batch)
        else:
            hidden = f"{path}/_layer-{batch_id}"
            batch.write.mode("overwrite").parquet(hidden)
            publish.make_folder(spark, f"{path}/layers")
            publish.rename(spark, hidden, layer)
        through = base[1]["through"] if base else -1
        held = _layers(spark, path, through)
        if len(held) < compact_every:
            return

        def merge(folder: str) -> dict:
            read_latest(spark, path, schema, keys).write.parquet(folder)
            return {"through": batch_id}
        publish.publish_generation(spark, f"{path}/base", merge)
        for i in held:                  # the base has them; read no more
            publish.delete(spark, f"{path}/layers/batch={i}")
    return per_batch


def _complete(spark: SparkSession, path: str):
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        done = publish.read_json(spark, f"{path}/{publish.COMPLETE}") or {}
        if done.get("load_id") == str(batch_id):
            return _consume(batch)
        publish.publish_table(spark, path, [batch], load_id=str(batch_id))
    return per_batch


def keyed_sink(df: DataFrame, path: str, checkpoint: str, output_mode: str,
               keys: Sequence[str], available_now: bool = False,
               trigger_interval: str = "10 seconds",
               compact_every: int = 16) -> StreamingQuery:
    """Start a stream of keyed results (an aggregate) into a table:
    ``read_latest`` reads it in update mode, ``publish.read_published`` in
    complete mode."""
    spark = df.sparkSession
    if output_mode == "update":
        put = _update(spark, path, df.schema, list(keys), compact_every)
    elif output_mode == "complete":
        put = _complete(spark, path)
    else:
        raise ValueError(f"Unsupported output mode: {output_mode}")
    w = (df.writeStream.outputMode(output_mode).foreachBatch(put)
         .option("checkpointLocation", checkpoint))
    w = (w.trigger(availableNow=True) if available_now
         else w.trigger(processingTime=trigger_interval))
    return w.start()
