"""ST1: records behind the watermark, kept and counted.

Spark drops a record that arrives after its window has closed, silently.
The gate stands before the stateful query and lets nothing get lost: each
micro-batch is parted by the watermark at which it arrives (the latest
event time of the batches before, less the delay) into an accepted table,
which the stateful query reads as its stream, and a side table of late
records.

The stateful query's watermark follows the accepted records.  As long as
each of its micro-batches takes whole batches of the gate, its watermark
is never ahead of the gate's: it drops none of what it is given, and every
record is either accepted or in the side table.  A limit on its files
could cut a batch, so the gate can give every accepted batch the same
number of files, and a limit must be a multiple of it.

A batch appears in one rename, with its watermark and counts in a small
file that is written last.  A repeated batch finds what is there: files
that the next query may have seen never change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reputation import parse_duration
from ..sources import publish
from ..sources.files import write_file_count

LOG = "_gate"
FILES = "_files.json"       # how many files an accepted batch has


def closes_at(ts_col: str, slide_seconds: int) -> Column:
    """Epoch microseconds at which a record's last bucket ends: the record
    is late once the watermark has come to it."""
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    step = int(slide_seconds) * 1_000_000
    return F.floor(us / step) * step + step


def late_log(spark: SparkSession, path: str) -> list[dict]:
    """A row per batch: batch_id, accepted, late, watermark (epoch
    microseconds at its start, None for the first), latest."""
    folder = f"{path}/{LOG}"
    found = [publish.read_json(spark, f"{folder}/{n}")
             for n in publish.names(spark, folder) if n.endswith(".json")]
    return sorted(found, key=lambda r: r["batch_id"])


def gate_late_records(stream: DataFrame, path: str, checkpoint: str,
                      delay: str = "10 minutes", slide="10 minutes",
                      ts_col: str = "timestamp",
                      available_now: bool = False,
                      trigger_interval: str = "5 seconds",
                      files: int | None = None) -> StreamingQuery:
    """Part a stream into ``path/accepted`` and ``path/late``, each with a
    folder per batch.  A record without a timestamp is accepted: it waits
    for no window.

    ``files``: each accepted batch has so many files (None: one per task
    with rows); it stays the same for all batches of a path."""
    spark = stream.sparkSession
    wait = parse_duration(delay) * 1_000_000
    closes = closes_at(ts_col, parse_duration(slide))

    def put(rows: DataFrame, name: str, batch_id: int,
            count: int | None = None) -> Observation:
        """Write beside the folder, then show it; a folder that stands was
        whole and stays."""
        seen = Observation()
        target = f"{path}/{name}/batch_id={batch_id}"
        hidden = f"{path}/_{name}-{batch_id}"
        us = F.unix_micros(F.col(ts_col).cast("timestamp"))
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"),
                            F.max(us).alias("latest"))
        if count:
            write_file_count(rows, hidden, count)
        else:
            rows.write.mode("overwrite").parquet(hidden)
        if publish.exists(spark, target):
            publish.delete(spark, hidden)
        else:
            publish.make_folder(spark, f"{path}/{name}")
            publish.rename(spark, hidden, target)
        return seen

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        before = publish.read_json(
            spark, f"{path}/{LOG}/{batch_id - 1}.json") or {}
        latest = before.get("latest")
        watermark = None if latest is None else latest - wait
        late = (F.lit(False) if watermark is None else F.coalesce(
            closes <= F.lit(watermark), F.lit(False)))
        batch.persist()         # written in two parts
        try:
            kept = put(batch.where(~late), "accepted", batch_id, files).get
            gone = put(batch.where(late), "late", batch_id).get
        finally:
            batch.unpersist()
        newest = max((x for x in (latest, kept["latest"])
                      if x is not None), default=None)
        publish.write_json(spark, f"{path}/{LOG}/{batch_id}.json", {
            "batch_id": batch_id, "accepted": kept["rows"],
            "late": gone["rows"], "watermark": watermark, "latest": newest})

    held = batch_files(spark, path)
    if held != files and publish.exists(spark, f"{path}/accepted"):
        raise ValueError(f"the batches in {path} have files: {held}, "
                         f"not {files}")
    publish.make_folder(spark, f"{path}/{LOG}")
    publish.write_json(spark, f"{path}/{FILES}", {"files": files})
    w = stream.writeStream.foreachBatch(per_batch).option(
        "checkpointLocation", checkpoint)
    w = (w.trigger(availableNow=True) if available_now
         else w.trigger(processingTime=trigger_interval))
    return w.start()


def batch_files(spark: SparkSession, path: str) -> int | None:
    """The number of files of each accepted batch, if it is fixed."""
    return (publish.read_json(spark, f"{path}/{FILES}") or {}).get("files")


def accepted_stream(spark: SparkSession, path: str, schema,
                    files_per_trigger: int | None = None) -> DataFrame:
    """What the gate has accepted, as a stream.  A limit on the files of a
    micro-batch must be a multiple of the number that the gate gives each
    batch: the first files of a batch would move the watermark past the
    records in the others."""
    reader = spark.readStream.schema(schema).option(
        "recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        each = batch_files(spark, path)
        if not each or files_per_trigger % each:
            raise ValueError(
                f"{files_per_trigger} files a trigger may cut a batch of the "
                f"gate (files of a batch: {each or 'any number'})")
        # files that the source keeps for later could be cut as well
        reader = reader.option("maxFilesPerTrigger", files_per_trigger
                               ).option("maxCachedFiles", 0)
    return reader.parquet(f"{path}/accepted")


def late_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """The side table: the records that came too late, with their batch."""
    cols = [f.name for f in schema.fields]
    return spark.read.schema(schema).parquet(f"{path}/late").select(
        *cols, "batch_id")
