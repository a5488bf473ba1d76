"""Bench: the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit",
"queries": {name: seconds}, "sf", "rows": {...}, "rows_per_sec": {...}}.
Each step runs its whole plan into Spark's ``noop`` sink (or its own file
sink), so nothing data-sized is collected and the timing is the job's.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from veracity.session import local_session
    spark = local_session("veracity-bench", cpus,
                          shuffle_partitions=max(8, int(cpus) * 2)
                          if cpus.isdigit() else 16)

    from veracity.operators import forest, quality, reports, reputation
    from veracity.operators import trust
    from veracity.params import ForestParams, TrustParams
    from veracity.plans import batch, catalog, catalog_forest, catalog_stream
    from veracity.plans import catalog_windows
    from veracity.plans import testdata as td

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    # warm-up: JVM, Python workers, parquet footers
    noop(td.events_feed(spark, sf_dir))

    events = td.events_feed(spark, sf_dir, with_key=True)
    rows["events"] = events.count()
    timed("quality_events", lambda: noop(quality.compute_quality_metrics(
        events, catalog.EVQ, td.EVENTS_AS_OF)))
    model = timed("forest_fit", lambda: forest.fit_isolation_forest(
        events, ForestParams(key_cols=("row_key",))))
    timed("forest_score", lambda: noop(model.transform(events)))

    def scored():
        q = quality.compute_quality_metrics(events, catalog.EVQ,
                                            td.EVENTS_AS_OF)
        r = reputation.compute_source_reputation(model.transform(q))
        return trust.compute_trust_score(r, TrustParams.batch(),
                                         td.EVENTS_AS_OF)

    timed("score_events_end_to_end", lambda: noop(scored()))
    timed("trust_by_source", lambda: reports.trust_by_source(scored())
          .collect())
    timed("rolling_reputation_bucketed", lambda: noop(
        catalog_windows.q_rolling_reputation_bucketed(spark, sf_dir)))
    timed("sliding_reputation", lambda: noop(
        catalog_windows.q_sliding_reputation(spark, sf_dir)))
    timed("ema_reputation", lambda: noop(
        catalog_windows.q_ema_reputation(spark, sf_dir)))
    timed("unify_feeds", lambda: noop(catalog.q_unify_feeds(spark, sf_dir)))

    feeds = [(td.dirty_table(spark, sf_dir, td.FEEDS[n]), td.mapping(
        td.FEEDS[n], tag=n)) for n in td.FOUR]
    res = timed("multi_source_job", lambda: batch.multi_source_job(
        spark, feeds, td.EVENTS_AS_OF))
    rows["multi_source_scored"] = res.scores.count()
    timed("isolation_flags_exact", lambda: noop(
        catalog_forest.q_isolation_flags_exact(spark, sf_dir)))
    rows["stream_trust"] = timed(
        "stream_trust", lambda: catalog_stream.q_stream_trust(
            spark, sf_dir).count())
    timed("stream_sliding_reputation", lambda: noop(
        catalog_stream.q_stream_sliding_reputation(spark, sf_dir)))
    timed("stream_reputation_exact", lambda: noop(
        catalog_stream.q_stream_reputation_exact(spark, sf_dir)))

    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "batch+stream trust scoring, total wall time",
        "value": total, "unit": "sec", "queries": times,
        "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
        "rows": rows,
        "rows_per_sec": {
            "score_events_end_to_end": round(
                rows["events"] / max(times["score_events_end_to_end"], 1e-9)),
            "multi_source_job": round(
                rows["multi_source_scored"] / max(times["multi_source_job"],
                                                  1e-9)),
        },
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
