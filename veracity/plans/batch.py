"""The reference's batch programs, as Spark jobs.

* ``score_records``: quality -> forest -> reputation -> decay -> trust.
* ``multi_source_job``: map and union feeds, cut the plan with a written
  table, score, write the 13-column output, report per source.
* ``single_source_job``: the same from one unified Parquet table (all
  rows; the reference's 20 000-row cap is not kept).
* ``analyze_upload``: the dashboard analysis of an arbitrary CSV (null
  token ``NULL``), returning the summary and the top-10 as small frames.

Results are written by the executors; nothing data-sized is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean, forest, quality, reports, reputation, trust
from ..operators import unify
from ..params import ForestParams, QualityParams, TrustParams
from ..operators.lookup import materialize
from ..session import delete_path, scratch_path
from ..sources import files, publish


def score_records(df: DataFrame, as_of=None,
                  qparams: QualityParams | None = None,
                  fparams: ForestParams | None = None,
                  tparams: TrustParams | None = None,
                  model: forest.IsolationForestModel | None = None
                  ) -> DataFrame:
    """Q7 -> A6 -> R1 -> T2 on unified records."""
    q = quality.compute_quality_metrics(df, qparams or QualityParams.batch(),
                                        as_of)
    m = model or forest.fit_isolation_forest(df, fparams or ForestParams(
        sample_fraction=0.02))
    r = reputation.compute_source_reputation(m.transform(q))
    return trust.compute_trust_score(r, tparams or TrustParams.batch(), as_of)


@dataclass
class JobResult:
    scores: DataFrame          # the written output, read back
    by_source: DataFrame       # P1
    counts: DataFrame          # U7


def multi_source_job(spark: SparkSession, feeds, as_of=None,
                     output_path: str | None = None,
                     unified_path: str | None = None) -> JobResult:
    """Feeds (frame, mapping) -> unified table -> scores table."""
    unified = unify.load_all_sources(feeds, as_of)
    # Cut the plan with a written table (also freezes as_of)
    upath = unified_path or scratch_path(spark, "unified")
    files.write_parquet(unified, upath)
    unified = spark.read.parquet(upath)
    scored = clean.final_projection(score_records(unified, as_of), True)
    out = publish.publish_table(
        spark, output_path or scratch_path(spark, "trust_scores"), [scored])
    counts = materialize(unify.feed_counts(unified))
    if unified_path is None:
        delete_path(spark, upath)
    return JobResult(out, reports.trust_by_source(out), counts)


def single_source_job(spark: SparkSession, unified_path: str, as_of=None,
                      output_path: str | None = None) -> DataFrame:
    df = spark.read.parquet(unified_path)
    scored = clean.final_projection(score_records(df, as_of, fparams=ForestParams(
        sample_fraction=0.05)), False)
    return publish.publish_table(
        spark, output_path or scratch_path(spark, "trust_scores"), [scored])


def analyze_upload(spark: SparkSession, path: str, as_of=None
                   ) -> tuple[DataFrame, DataFrame]:
    """U11 + Q7 + A6 + R1 + T2, then P4 and P5, on a CSV upload."""
    raw = files.read_csv(spark, path, null_value="NULL", infer=True)
    df = unify.adapt_schema(raw, as_of)
    scored = reports.persist_scored(score_records(
        df, as_of, fparams=ForestParams(sample_fraction=0.1)))
    out = (materialize(reports.trust_summary(scored)),
           materialize(reports.top_anomalies(scored, 10)))
    scored.unpersist()
    return out
