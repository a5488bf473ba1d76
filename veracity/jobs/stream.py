"""Run the scoring stream from Kafka, or from a folder of JSON messages."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..sources import messages
from ..streaming.job import StreamingPipelineConfig, create_streaming_pipeline


def parser() -> argparse.ArgumentParser:
    d = StreamingPipelineConfig()
    p = argparse.ArgumentParser(prog="veracity.jobs.stream",
                                description=__doc__)
    p.add_argument("--model", default=d.model_path)
    p.add_argument("--output", default=d.output_path)
    p.add_argument("--checkpoint", default=d.checkpoint_dir)
    p.add_argument("--mode", default=d.reputation_mode,
                   choices=["sliding", "exact", "micro_batch"])
    p.add_argument("--bootstrap-servers", default=d.kafka_bootstrap_servers)
    p.add_argument("--topic", default=d.kafka_topic)
    p.add_argument("--messages", help="folder of text files, a JSON message "
                                      "per line, read instead of Kafka")
    p.add_argument("--available-now", action="store_true",
                   help="process what is there, then stop")
    p.add_argument("--all-columns", action="store_true")
    p.add_argument("--adopt-settings", action="store_true",
                   help="go on from a checkpoint without a record of its "
                        "settings: those given are the ones it ran with")
    return p


def main(argv: list[str] | None = None,
         spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("stream").getOrCreate()
    cfg = StreamingPipelineConfig(
        model_path=args.model, output_path=args.output,
        checkpoint_dir=args.checkpoint, reputation_mode=args.mode,
        kafka_bootstrap_servers=args.bootstrap_servers,
        kafka_topic=args.topic, include_intermediate=args.all_columns,
        adopt_settings=args.adopt_settings)
    source = None
    if args.messages:
        source = messages.prepare_ingestion_fields(
            messages.parse_messages(spark.readStream.text(args.messages)))
    query = create_streaming_pipeline(spark, cfg, source=source,
                                      available_now=args.available_now)
    query.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
