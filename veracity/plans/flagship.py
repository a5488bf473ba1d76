"""The flagship query used by the smoke check: the reference's batch job
(quality, isolation-forest flags, reputation, decay, trust) on events,
reported per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports
from .catalog_forest import forest_scored


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trust_by_source(forest_scored(spark, sf_dir))
