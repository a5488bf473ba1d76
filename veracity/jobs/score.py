"""Score one unified table, or the four raw feeds of a folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..plans import batch
from ..sources import files
from ..sources.feeds import LOADER_MAPPINGS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veracity.jobs.score",
                                description=__doc__)
    given = p.add_mutually_exclusive_group(required=True)
    given.add_argument("--unified", help="Parquet table of unified records")
    given.add_argument("--feeds", help="folder with the raw CSV feeds")
    p.add_argument("--output", required=True, help="folder of the scores")
    p.add_argument("--allow-missing", action="store_true",
                   help="score the feeds that are there (default: all four "
                        "must be)")
    p.add_argument("--as-of", default=None,
                   help="time the records are judged at (default: now)")
    return p


def main(argv: list[str] | None = None,
         spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("score").getOrCreate()
    if args.unified:
        out = batch.single_source_job(spark, args.unified, args.as_of,
                                      args.output)
        print(f"{out.count()} records scored in {args.output}")
        return 0
    absent = [m.file for m in LOADER_MAPPINGS
              if not files.path_exists(spark, f"{args.feeds}/{m.file}")]
    feeds = [(files.read_csv(spark, f"{args.feeds}/{m.file}"), m)
             for m in LOADER_MAPPINGS if m.file not in absent]
    if absent and not args.allow_missing or not feeds:
        print(f"not in {args.feeds}: {', '.join(absent)}", file=sys.stderr)
        return 1
    result = batch.multi_source_job(spark, feeds, args.as_of, args.output)
    for r in result.by_source.collect():    # a row per source
        print(r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
