"""Streaming queries: the events table replayed as a file stream.

Each query runs its stream to completion (``availableNow``) into a fresh
folder under the shared checkpoint folder and returns the written table.
Stateful modes emit only what the final watermark has closed (records of
the last 10 minutes of event time stay in state), and the oracles say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import QualityParams
from ..session import scratch_path
from ..sources.files import write_file_count
from ..sources.publish import read_published
from ..streaming.job import (StreamingPipelineConfig, build_stream,
                             window_counts, with_watermark)
from ..streaming.late import accepted_stream, gate_late_records, late_records
from ..streaming.sinks import create_output_sink
from ..streaming.state import exact_stream_reputation, rocksdb_state
from ..streaming.windows import keyed_sink, read_latest
from . import oracle as O
from . import testdata as td
from .catalog import register
from .catalog_forest import FOREST_CTES
from .catalog_windows import _A, _FLAGGED, SLIDING_SQL

_SQ = QualityParams.streaming()


PARTS = 5
FILE_ROWS = 200_000     # of a part's file, about
LATE_KEY, LATE_BEFORE = 97, "2024-01-20 00:00:00"


def part_files(spark: SparkSession, sf_dir: str) -> int:
    """Files of each part: they grow in number with the events, not in
    size."""
    rows = td.table(spark, sf_dir, "events").count()
    return max(1, -(-rows // (PARTS * FILE_ROWS)))


def write_event_parts(spark: SparkSession, sf_dir: str, folder: str,
                      parts=range(PARTS + 1)) -> None:
    """The events as ``PARTS`` parts in time order and one more with rows
    held back from the earlier ones, written one after the other, each as
    ``part_files`` files."""
    e = td.table(spark, sf_dir, "events")
    late = (F.col("event_id") % LATE_KEY == 0) & (
        F.col("ts") < F.lit(LATE_BEFORE).cast("timestamp_ntz"))
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01"))
    part = F.when(late, PARTS).otherwise(
        F.least(F.floor(day / 6), F.lit(PARTS - 1)))
    n = part_files(spark, sf_dir)
    for k in parts:
        write_file_count(e.where(part == k).repartition(n), folder, n,
                         "append")


def events_stream(spark: SparkSession, sf_dir: str, folder: str | None = None
                  ) -> DataFrame:
    """The events file (or the parts in a folder, one per micro-batch) as
    a stream, mapped to the message record."""
    schema = td.table(spark, sf_dir, "events").schema
    # no files kept for later: the last ones kept could be less than a part
    reader = spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", part_files(spark, sf_dir) if folder else 1
        ).option("maxCachedFiles", 0)
    raw = reader.parquet(folder) if folder else reader.option(
        "pathGlobFilter", "events.parquet").parquet(sf_dir)
    from ..operators.unify import map_feed
    dirty = td.dirty_frame(raw, td.EVENTS, with_key=True)
    rec = map_feed(dirty, td.mapping(td.EVENTS), keep=("row_key",))
    return (rec.withColumnRenamed("amount", "purchase_amount")
            .withColumn("ingestion_timestamp",
                        F.lit(td.EVENTS_AS_OF).cast("timestamp")))


def run_to_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    out, ckpt = scratch_path(spark, name), scratch_path(spark, name + "-ckpt")
    q = create_output_sink(df, "parquet", out, ckpt, "append",
                           available_now=True)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stream_flags(df: DataFrame) -> DataFrame:
    a = F.coalesce(F.col("purchase_amount"), F.lit(0.0))
    return df.withColumns({"is_anomaly": a > F.lit(td.GIVEN_FLAG_BOUND),
                           "anomaly_severity": a / F.lit(td.GIVEN_FLAG_BOUND) - 1.0})


_STREAM_FEED = f"""f AS (SELECT row_key, user_id, amount AS purchase_amount, city,
  "timestamp", source_id, ingestion_timestamp FROM ({O.events_sql(True)}))"""
DIMS = ("completeness", "consistency", "accuracy", "freshness", "timeliness")


@register("stream_quality", f"""WITH {_STREAM_FEED}
SELECT row_key, {O.quality_sql("stream", td.EVENTS_AS_OF)} FROM f""", DIMS)
def q_stream_quality(spark, sf_dir):
    """Q7 on a stream (stateless: every record comes out)."""
    from ..operators import quality
    s = quality.compute_quality_metrics(events_stream(spark, sf_dir), _SQ,
                                        td.EVENTS_AS_OF)
    return run_to_table(spark, s.select("row_key", *DIMS), "stream_quality")


# final watermark: latest event time minus the 10-minute delay
_WM = ("(SELECT max(CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END) "
       "- INTERVAL 10 MINUTE FROM events)")


@register("stream_sliding_reputation", f"""
SELECT s.*, e."timestamp" FROM ({SLIDING_SQL}) AS s
JOIN ({O.events_sql(True)}) AS e USING (row_key)
WHERE window_end <= {_WM} OR e."timestamp" IS NULL""",
          ("source_reputation",))
def q_stream_sliding_reputation(spark, sf_dir):
    """ST1 + ST5: watermark, hopping windows, stream-stream join back."""
    s = with_watermark(stream_flags(events_stream(spark, sf_dir))
                       .withColumnRenamed("purchase_amount", "amount"))
    from ..streaming.job import sliding_stream_reputation
    out = sliding_stream_reputation(s)
    return run_to_table(spark, out.select(
        "row_key", "source_id", "timestamp", "window_start", "window_end",
        "anomalies_in_window", "total_in_window", "source_reputation"),
        "stream_sliding")


_IN_TIME = (f"""SELECT * FROM ({O.events_sql(True)}) WHERE NOT COALESCE(
  row_key % {LATE_KEY} = 0 AND "timestamp" < TIMESTAMP '{LATE_BEFORE}',
  FALSE)""")


@register("stream_sliding_batches", f"""
SELECT s.* FROM ({SLIDING_SQL.replace(O.events_sql(True), _IN_TIME)}) AS s
JOIN ({O.events_sql(True)}) AS e USING (row_key)
WHERE window_end <= {_WM} OR e."timestamp" IS NULL""",
          ("source_reputation",))
def q_stream_sliding_batches(spark, sf_dir):
    """ST1 + ST5 over six micro-batches: the watermark moves, windows close
    between batches, and the last file's late records are left out."""
    folder = scratch_path(spark, "event-parts")
    write_event_parts(spark, sf_dir, folder)
    return run_to_table(spark, sliding_columns(
        events_stream(spark, sf_dir, folder)), "stream_batches")


def sliding_columns(stream: DataFrame) -> DataFrame:
    from ..streaming.job import sliding_stream_reputation
    s = with_watermark(stream_flags(stream).withColumnRenamed(
        "purchase_amount", "amount"))
    return sliding_stream_reputation(s).select(
        "row_key", "source_id", "window_start", "window_end",
        "anomalies_in_window", "total_in_window", "source_reputation")


@register("stream_late_records", f"""
WITH {_FLAGGED}
SELECT q.row_key, q.source_id, q."timestamp",
  CASE WHEN q.row_key % {LATE_KEY} = 0
         AND q."timestamp" < TIMESTAMP '{LATE_BEFORE}' THEN 'late'
       WHEN q."timestamp" IS NULL THEN 'no time'
       WHEN s.window_end <= {_WM} THEN 'scored' ELSE 'open' END AS fate
FROM q LEFT JOIN ({SLIDING_SQL}) AS s ON s.row_key = q.row_key""")
def q_stream_late_records(spark, sf_dir):
    """ST1: what becomes of every input record of the six micro-batches:
    late (in the side table), scored, waiting for its window, or without a
    time."""
    parts = scratch_path(spark, "event-parts")
    write_event_parts(spark, sf_dir, parts)
    gate = scratch_path(spark, "gate")
    stream = events_stream(spark, sf_dir, parts)
    n = part_files(spark, sf_dir)
    gate_late_records(stream, gate, scratch_path(spark, "gate-ckpt"),
                      available_now=True, files=n).awaitTermination()
    accepted = accepted_stream(spark, gate, stream.schema, n)
    scored = run_to_table(spark, sliding_columns(accepted), "gate-scored")
    late = late_records(spark, gate, stream.schema).select(
        "row_key", F.lit("late").alias("fate"))
    fate = late.unionByName(scored.select("row_key", F.when(
        F.col("window_end").isNull(), "no time").otherwise("scored").alias(
            "fate")))
    rec = td.events_feed(spark, sf_dir, with_key=True).select(
        "row_key", "source_id", "timestamp")
    return rec.join(fate, "row_key", "left").withColumn(
        "fate", F.coalesce("fate", F.lit("open")))


def _windows_sql(events: str) -> str:
    """Every hopping window of an hour, ten minutes apart."""
    return f"""
WITH b AS (SELECT source_id, CAST(floor(epoch("timestamp") / 600) AS BIGINT)
    AS b, SUM(CASE WHEN COALESCE(amount, 0.0) > 150.0 THEN 1 ELSE 0 END) AS a,
    COUNT(*) AS n FROM ({events})
  WHERE "timestamp" IS NOT NULL AND source_id IS NOT NULL
  GROUP BY ALL),
w AS (SELECT source_id, unnest(range(b + 1, b + 7)) AS e, a, n FROM b)
SELECT make_timestamp((e - 6) * 600000000) AS window_start,
  make_timestamp(e * 600000000) AS window_end, source_id,
  SUM(a)::BIGINT AS anomalies_in_window, SUM(n)::BIGINT AS total_in_window
FROM w GROUP BY e, source_id"""


def _window_table(spark, sf_dir, mode: str) -> DataFrame:
    parts = scratch_path(spark, "event-parts")
    write_event_parts(spark, sf_dir, parts)
    flagged = with_watermark(stream_flags(events_stream(spark, sf_dir, parts)))
    wins = window_counts(flagged).select(
        F.col("win.start").alias("window_start"),
        F.col("win.end").alias("window_end"), "source_id",
        "anomalies_in_window", "total_in_window")
    keys = ["window_start", "window_end", "source_id"]
    path = scratch_path(spark, f"windows-{mode}")
    keyed_sink(wins, path, scratch_path(spark, "windows-ckpt"), mode, keys,
               available_now=True, compact_every=4).awaitTermination()
    if mode == "update":
        return read_latest(spark, path, wins.schema, keys)
    return read_published(spark, path)


@register("stream_window_update", _windows_sql(_IN_TIME))
def q_stream_window_update(spark, sf_dir):
    """ST3, update mode: changed windows merged into a table batch by
    batch; late records change nothing."""
    return _window_table(spark, sf_dir, "update")


@register("stream_window_complete", _windows_sql(O.events_sql(True)))
def q_stream_window_complete(spark, sf_dir):
    """ST3, complete mode: all windows after every batch; nothing closes,
    so no record is late."""
    return _window_table(spark, sf_dir, "complete")


EXACT_SQL = f"""WITH {_FLAGGED},
k AS (SELECT *, CAST(floor(epoch("timestamp")) AS BIGINT) AS sec FROM q
      WHERE "timestamp" IS NOT NULL),
w AS (SELECT row_key, user_id, source_id, amount, city, "timestamp", sec, CAST(SUM({_A}) OVER win AS BIGINT) AS a,
        COUNT(*) OVER win AS n FROM k
      WINDOW win AS (PARTITION BY source_id ORDER BY sec
                     RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))
SELECT row_key, user_id, source_id, amount, city, "timestamp",
  a AS anomalies_in_window, n AS total_in_window, 1.0::DOUBLE - a::DOUBLE / n AS source_reputation
FROM w WHERE sec + 1 <= epoch({_WM})
UNION ALL SELECT row_key, user_id, source_id, amount, city, NULL, NULL,
  NULL, NULL FROM q
WHERE "timestamp" IS NULL"""


@register("stream_reputation_exact", EXACT_SQL,
          ("amount", "source_reputation"))
def q_stream_reputation_exact(spark, sf_dir):
    """ST6: keyed-state trailing window, equal to the batch R2 values for
    every record whose second the final watermark has closed."""
    s = with_watermark(stream_flags(events_stream(spark, sf_dir))
                       .withColumnRenamed("purchase_amount", "amount"))
    out = exact_stream_reputation(s, 3600)
    with rocksdb_state(spark):
        return run_to_table(spark, out.select(
            "row_key", "user_id", "source_id", "amount", "city", "timestamp",
            "anomalies_in_window", "total_in_window", "source_reputation"),
            "stream_exact")


# quality, forest flags and sliding reputation of the stream's records
STREAM_TRUST_SQL = f"""WITH RECURSIVE {FOREST_CTES}, {_STREAM_FEED},
q AS (SELECT f.*, {O.quality_sql("stream", td.EVENTS_AS_OF)}, flags.is_anomaly,
        flags.anomaly_severity,
        CAST(floor(epoch("timestamp") / 600) AS BIGINT) AS b
      FROM f JOIN flags USING (row_key)),
pb AS (SELECT source_id, b, SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS a,
         COUNT(*) AS n FROM q WHERE b IS NOT NULL GROUP BY source_id, b),
w AS (SELECT source_id, b, SUM(a) OVER win AS wa, SUM(n) OVER win AS wn FROM pb
      WINDOW win AS (PARTITION BY source_id ORDER BY b
                     RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)),
s AS (SELECT q.*, 1.0::DOUBLE - w.wa::DOUBLE / w.wn AS source_reputation,
        exp(-0.05::DOUBLE * datediff('day', ingestion_timestamp,
            {O.ts_lit(td.EVENTS_AS_OF)})) AS temporal_decay
      FROM q LEFT JOIN w ON q.source_id = w.source_id AND q.b = w.b
      WHERE q.b IS NULL OR (q.b + 1) * 600 <= epoch({_WM}))
SELECT user_id, source_id, purchase_amount, city, "timestamp", completeness,
  consistency, accuracy, freshness, timeliness, is_anomaly, anomaly_severity,
  source_reputation, temporal_decay, {O.QSUM} / 5.0::DOUBLE
  * COALESCE(source_reputation, 0.5::DOUBLE) * temporal_decay * 100.0::DOUBLE
  AS trust_score FROM s"""
FULL_DOUBLES = ("purchase_amount",) + DIMS + (
    "anomaly_severity", "source_reputation", "temporal_decay", "trust_score")


@register("stream_trust", STREAM_TRUST_SQL, FULL_DOUBLES)
def q_stream_trust(spark, sf_dir):
    """ST7 end to end on a stream: quality, forest scores (model fitted on
    the batch table), sliding reputation, stream trust, short output."""
    from .catalog_forest import events_forest
    _, model = events_forest(spark, sf_dir)
    cfg = StreamingPipelineConfig(include_intermediate=True)
    out = build_stream(events_stream(spark, sf_dir), model, cfg,
                       td.EVENTS_AS_OF)
    return run_to_table(spark, out, "stream_trust")


# the same with the exact trailing hour instead of the sliding windows
_SLIDING_CTES = STREAM_TRUST_SQL[STREAM_TRUST_SQL.index("pb AS ("):
                                 STREAM_TRUST_SQL.index("s AS (SELECT q.*")]
STREAM_TRUST_EXACT_SQL = STREAM_TRUST_SQL.replace(_SLIDING_CTES, """
k AS (SELECT *, CAST(floor(epoch("timestamp")) AS BIGINT) AS sec FROM q
      WHERE "timestamp" IS NOT NULL),
w AS (SELECT row_key, SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END) OVER win
        AS wa, COUNT(*) OVER win AS wn, sec FROM k
      WINDOW win AS (PARTITION BY source_id ORDER BY sec
                     RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)),
""").replace("FROM q LEFT JOIN w ON q.source_id = w.source_id AND q.b = w.b",
             "FROM q LEFT JOIN w ON q.row_key = w.row_key").replace(
    "(q.b + 1) * 600 <= epoch", "w.sec + 1 <= epoch")


@register("stream_trust_exact", STREAM_TRUST_EXACT_SQL, FULL_DOUBLES)
def q_stream_trust_exact(spark, sf_dir):
    """ST6-ST8 end to end in exact mode: started from its configuration,
    with its own sink and checkpoint."""
    from .catalog_forest import events_forest
    from ..streaming.job import create_streaming_pipeline
    _, model = events_forest(spark, sf_dir)
    cfg = StreamingPipelineConfig(
        reputation_mode="exact", include_intermediate=True,
        output_path=scratch_path(spark, "trust-exact"),
        checkpoint_dir=scratch_path(spark, "trust-exact-ckpt"))
    create_streaming_pipeline(
        spark, cfg, model=model, source=events_stream(spark, sf_dir),
        available_now=True, as_of=td.EVENTS_AS_OF).awaitTermination()
    return spark.read.parquet(cfg.output_path)


@register("stream_forest_scoring", f"""WITH RECURSIVE {FOREST_CTES}
SELECT row_key, source_id, amount AS purchase_amount, is_anomaly,
  anomaly_severity FROM e JOIN flags USING (row_key)""",
          ("purchase_amount", "anomaly_severity"))
def q_stream_forest_scoring(spark, sf_dir):
    """A saved forest applied to a stream, no fitting in the stream."""
    from .catalog_forest import events_forest
    from ..operators.forest import IsolationForestModel
    _, model = events_forest(spark, sf_dir)
    path = scratch_path(spark, "forest-model")
    model.save(spark, path)
    loaded = IsolationForestModel.load(spark, path)
    s = loaded.transform(events_stream(spark, sf_dir),
                         feature_col="purchase_amount")
    return run_to_table(spark, s.select("row_key", "source_id",
                                        "purchase_amount", "is_anomaly",
                                        "anomaly_severity"), "stream_forest")


@register("stream_micro_batch", f"""WITH {_STREAM_FEED},
q AS (SELECT *, {O.quality_sql("stream", td.EVENTS_AS_OF)},
        COALESCE(purchase_amount, 0.0::DOUBLE) > 150.0 AS is_anomaly,
        COALESCE(purchase_amount, 0.0::DOUBLE) / 150.0::DOUBLE - 1.0::DOUBLE
          AS anomaly_severity FROM f),
r AS (SELECT source_id, 1.0::DOUBLE - SUM(CASE WHEN is_anomaly THEN 1 ELSE 0
        END)::DOUBLE / COUNT(*) AS source_reputation FROM q GROUP BY source_id)
SELECT user_id, q.source_id, purchase_amount, city, "timestamp", completeness,
  consistency, accuracy, freshness, timeliness, is_anomaly, anomaly_severity,
  source_reputation, 1.0::DOUBLE AS temporal_decay,
  {O.QSUM} / 5.0::DOUBLE * source_reputation * 100.0::DOUBLE AS trust_score,
  0 AS batch_id
FROM q LEFT JOIN r ON q.source_id = r.source_id""", FULL_DOUBLES)
def q_stream_micro_batch(spark, sf_dir):
    """ST9: per-micro-batch reputation (R4) inside ``foreachBatch``."""
    from ..streaming.job import create_streaming_pipeline
    out = scratch_path(spark, "stream-mb")
    cfg = StreamingPipelineConfig(
        output_path=out, checkpoint_dir=scratch_path(spark, "stream-mb-ckpt"),
        reputation_mode="micro_batch", include_intermediate=True)
    q = create_streaming_pipeline(spark, cfg, model=stream_flags,
                                  source=events_stream(spark, sf_dir),
                                  available_now=True, as_of=td.EVENTS_AS_OF)
    q.awaitTermination()
    return spark.read.parquet(out)

