"""A10: train the anomaly model on a CSV and save it."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..operators import forest
from ..sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veracity.jobs.train",
                                description=__doc__)
    p.add_argument("--input", required=True, help="CSV with a header")
    p.add_argument("--output", required=True, help="folder of the model")
    p.add_argument("--sample-fraction", type=float, default=0.1)
    p.add_argument("--contamination", type=float, default=0.05)
    p.add_argument("--amount-column", default="purchase_amount",
                   help="used when the file has no column 'amount'")
    return p


def main(argv: list[str] | None = None,
         spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("train").getOrCreate()
    if not files.path_exists(spark, args.input):
        print(f"input not found: {args.input}", file=sys.stderr)
        return 1
    df = files.read_csv(spark, args.input)
    if "amount" not in df.columns:
        df = df.withColumnRenamed(args.amount_column, "amount")
    if "amount" not in df.columns:
        print(f"neither 'amount' nor '{args.amount_column}' in "
              f"{df.columns}", file=sys.stderr)
        return 1
    df = df.withColumn("amount", df["amount"].try_cast("double"))
    model = forest.train_model(df, args.output, args.sample_fraction,
                               args.contamination)
    print(f"model in {args.output}: {model.sample_size} rows sampled, "
          f"threshold {model.threshold:.6f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
