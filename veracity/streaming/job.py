"""ST1-ST9: the scoring stream.

source -> parse -> watermark -> quality -> forest scores -> reputation ->
trust -> projection -> sink, as one chain of DataFrame transformations
shared with the batch job.  Three reputation modes, because the
reference's analytic window cannot run on a stream (Spark rejects
non-time windows there):

* ``sliding`` (default): per-source hopping windows (1 h every 10 min)
  aggregated with the watermark, joined back to each record by a
  stream-stream join on (source, window).  The join key is the window
  struct itself, so both sides' state is evicted by the watermark.
* ``exact``: keyed state of per-second counts per source
  (``veracity.streaming.state``) that reproduces the batch trailing-window
  value record for record; it needs the RocksDB state store.
* ``micro_batch``: whole-micro-batch reputation (R4) in ``foreachBatch``.
"""

from __future__ import annotations

from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean, quality, reputation, trust
from ..operators.forest import IsolationForestModel
from ..params import QualityParams, TrustParams
from ..sources import messages
from .settings import settle
from .sinks import create_output_sink
from .state import exact_stream_reputation, rocksdb_state


@dataclass
class StreamingPipelineConfig:
    """ST8: settings of the scoring stream (defaults as the reference)."""

    # --- fixed values: published defaults ---
    kafka_bootstrap_servers: str = "localhost:9092"
    kafka_topic: str = messages.DEFAULT_TOPIC
    starting_offsets: str = "latest"
    output_path: str = "data/streaming_output"
    checkpoint_dir: str = "checkpoints/trust_scores"
    output_mode: str = "append"
    output_format: str = "parquet"
    trigger_interval: str = "5 seconds"
    watermark_delay: str = "10 minutes"
    model_path: str = "models/isolation_forest"
    window_duration: str = "1 hour"
    sliding_duration: str = "10 minutes"
    # --- end of fixed values ---
    # state partitions that share one source's records of a bucket
    reputation_salts: int = 4
    reputation_mode: str = "sliding"
    include_intermediate: bool = False
    max_offsets_per_trigger: int | None = None
    # go on from a checkpoint that has no record of its settings
    adopt_settings: bool = False


def with_watermark(df: DataFrame, delay: str = "10 minutes",
                   ts_col: str = "timestamp") -> DataFrame:
    """ST1: the only late-data rule."""
    return df.withWatermark(ts_col, delay)


def score_stream(df: DataFrame, model, config: StreamingPipelineConfig,
                 as_of=None, qparams: QualityParams | None = None
                 ) -> DataFrame:
    """Quality and forest scores of a parsed, watermarked stream.

    ``model`` is a fitted forest, or any callable frame -> flagged frame.
    """
    qp = qparams or QualityParams.streaming()
    q = quality.compute_quality_metrics(df, qp, as_of)
    if callable(model) and not isinstance(model, IsolationForestModel):
        return model(q)
    return model.transform(q, feature_col=qp.amount_col)


def window_counts(df: DataFrame, window_seconds: int = 3600,
                  slide_seconds: int = 600, source_col: str = "source_id",
                  ts_col: str = "timestamp",
                  flag_col: str = "is_anomaly") -> DataFrame:
    """ST5: (win, source, anomalies_in_window, total_in_window) of every
    hopping window; records without a source or timestamp are in none."""
    return (df.where(F.col(ts_col).isNotNull() & F.col(source_col).isNotNull())
            .groupBy(F.window(ts_col, f"{window_seconds} seconds",
                              f"{slide_seconds} seconds").alias("win"),
                     F.col(source_col))
            .agg(F.sum(F.col(flag_col).cast("long"))
                 .alias("anomalies_in_window"),
                 F.count(F.lit(1)).alias("total_in_window")))


def sliding_stream_reputation(df: DataFrame, window_duration="1 hour",
                              sliding_duration="10 minutes",
                              source_col: str = "source_id",
                              ts_col: str = "timestamp",
                              salts: int = 4) -> DataFrame:
    """ST5 on a stream: each record joins the window that closes at the
    end of its slide bucket, [end - W, end).

    A window is one small row; it is copied ``salts`` times and a record
    picks a copy by its hash, so the records of one source and bucket go
    to ``salts`` state partitions.  A record without a source or timestamp
    belongs to no window: it passes at once with a null reputation.
    """
    W = reputation.parse_duration(window_duration)
    S = reputation.parse_duration(sliding_duration)
    if W % S:
        raise ValueError("window must be a multiple of the slide")
    placed = df.where(F.col(ts_col).isNotNull()
                      & F.col(source_col).isNotNull())
    # a window goes by its last slide, so a record has one key, not W / S
    wins = (window_counts(df, W, S, source_col, ts_col)
            .withColumn("__last", F.struct(
                (F.col("win.end") - F.expr(f"INTERVAL {S} SECONDS")).alias(
                    "start"), F.col("win.end").alias("end")))
            .withColumnRenamed(source_col, "__src")
            .withColumn("__wsalt", F.explode(F.sequence(
                F.lit(0), F.lit(salts - 1)))))
    recs = (placed.withColumn("__salt", F.pmod(
                F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
            .withColumn("__slide", F.window(ts_col, f"{S} seconds"))
            .withColumn("__t", F.unix_micros(F.col(ts_col).cast("timestamp")))
            .drop(ts_col))
    joined = recs.join(wins, (recs["__slide"] == wins["__last"])
                       & (recs[source_col] == wins["__src"])
                       & (recs["__salt"] == wins["__wsalt"]), "inner")
    joined = (joined.select(
        recs["*"], "anomalies_in_window", "total_in_window",
        (1.0 - F.col("anomalies_in_window") / F.col("total_in_window"))
        .alias("source_reputation"),
        wins["win.start"].alias("window_start"),
        wins["win.end"].alias("window_end"))
        .withColumn(ts_col, F.timestamp_micros("__t"))
        .drop("__t", "__slide", "__salt"))
    rest = df.where(F.col(ts_col).isNull() | F.col(source_col).isNull())
    rest = rest.select(
        *df.columns, F.lit(None).cast("long").alias("anomalies_in_window"),
        F.lit(None).cast("long").alias("total_in_window"),
        F.lit(None).cast("double").alias("source_reputation"),
        F.lit(None).cast("timestamp").alias("window_start"),
        F.lit(None).cast("timestamp").alias("window_end"))
    return joined.unionByName(rest)


def apply_stream_reputation(df: DataFrame, config: StreamingPipelineConfig
                            ) -> DataFrame:
    mode = config.reputation_mode
    if mode == "sliding":
        return sliding_stream_reputation(df, config.window_duration,
                                         config.sliding_duration,
                                         salts=config.reputation_salts)
    if mode == "exact":
        return exact_stream_reputation(
            df, reputation.parse_duration(config.window_duration),
            salts=config.reputation_salts)
    raise ValueError(f"unknown reputation mode {mode}")


def build_stream(parsed: DataFrame, model: IsolationForestModel,
                 config: StreamingPipelineConfig, as_of=None) -> DataFrame:
    """ST7 minus source and sink: the transformation chain."""
    wm = with_watermark(parsed, config.watermark_delay)
    scored = apply_stream_reputation(score_stream(wm, model, config, as_of),
                                     config)
    out = trust.compute_trust_score(scored, TrustParams.streaming(), as_of)
    return clean.prepare_output_columns(out, config.include_intermediate)


def create_streaming_pipeline(spark: SparkSession,
                              config: StreamingPipelineConfig | None = None,
                              model: IsolationForestModel | None = None,
                              source: DataFrame | None = None,
                              available_now: bool = False,
                              as_of=None) -> StreamingQuery:
    """ST7: source (Kafka by default, or any parsed streaming frame),
    scoring chain, sink with checkpoint; returns the running query.

    On a checkpoint that has run before, the settings of its state hold
    (ST4, ``settings.settle``)."""
    cfg = config or StreamingPipelineConfig()
    cfg = settle(spark, cfg, cfg.adopt_settings)
    m = model or IsolationForestModel.load(spark, cfg.model_path)
    if cfg.reputation_mode == "micro_batch":
        return _micro_batch_pipeline(spark, cfg, m, source, available_now,
                                     as_of)
    parsed = source if source is not None else messages.load_and_parse_kafka(
        spark, cfg.kafka_bootstrap_servers, cfg.kafka_topic,
        starting_offsets=cfg.starting_offsets,
        max_offsets_per_trigger=cfg.max_offsets_per_trigger, as_of=as_of)
    out = build_stream(parsed, m, cfg, as_of)
    store = (rocksdb_state(spark) if cfg.reputation_mode == "exact"
             else nullcontext())
    with store:
        return create_output_sink(out, cfg.output_format, cfg.output_path,
                                  cfg.checkpoint_dir, cfg.output_mode,
                                  cfg.trigger_interval, available_now)


def _micro_batch_pipeline(spark, cfg, model, source, available_now, as_of):
    """ST9: score each micro-batch as a bounded frame (R4 per batch)."""
    parsed = source if source is not None else messages.load_and_parse_kafka(
        spark, cfg.kafka_bootstrap_servers, cfg.kafka_topic,
        starting_offsets=cfg.starting_offsets,
        max_offsets_per_trigger=cfg.max_offsets_per_trigger, as_of=as_of)
    scored = score_stream(parsed, model, cfg, as_of)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()     # read twice: the sources' counts, the records
        try:
            r = reputation.compute_source_reputation_batch_reference(batch)
            out = trust.compute_trust_score(r, TrustParams.streaming(), as_of)
            # one folder per batch, overwritten on a retry: exactly-once
            # output
            (clean.prepare_output_columns(out, cfg.include_intermediate)
             .write.mode("overwrite").format(cfg.output_format)
             .save(f"{cfg.output_path}/batch_id={batch_id}"))
        finally:
            batch.unpersist()

    w = (scored.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", cfg.checkpoint_dir))
    w = (w.trigger(availableNow=True) if available_now
         else w.trigger(processingTime=cfg.trigger_interval))
    return w.start()
