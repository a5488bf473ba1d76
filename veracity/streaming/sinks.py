"""Output sinks of a scoring stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

SUPPORTED = ("console", "parquet", "csv", "memory")


def create_output_sink(df: DataFrame, output_format: str = "parquet",
                       output_path: str | None = None,
                       checkpoint_dir: str | None = None,
                       output_mode: str = "append",
                       trigger_interval: str | None = "10 seconds",
                       available_now: bool = False,
                       query_name: str | None = None,
                       partition_by=()) -> StreamingQuery:
    """Start the stream into console (20 rows, untruncated), Parquet, CSV
    (with header) or memory; any other format raises ``ValueError``.

    The checkpoint folder holds offsets and state, so a restarted query
    resumes where it stopped (exactly-once for the file sinks).
    ``available_now`` processes what is there and stops (tests, backfill).
    """
    fmt = output_format.lower()
    if fmt not in SUPPORTED:
        raise ValueError(f"Unsupported output format: {output_format}")
    w = df.writeStream.outputMode(output_mode).format(fmt)
    if fmt == "console":
        w = w.option("numRows", 20).option("truncate", "false")
    if fmt == "csv":
        w = w.option("header", "true")
    if fmt in ("parquet", "csv"):
        if not output_path:
            raise ValueError("a path is needed for file sinks")
        w = w.option("path", output_path)
        if partition_by:
            w = w.partitionBy(*partition_by)
    if checkpoint_dir:
        w = w.option("checkpointLocation", checkpoint_dir)
    if query_name or fmt == "memory":
        w = w.queryName(query_name or "trust_scores")
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_interval:
        w = w.trigger(processingTime=trigger_interval)
    return w.start()
