"""Registered queries over the driver's tables, each with its SQL oracle.

Every query reads whole tables (no id subsets, no caps beyond a top-k or
replay limit that is the operator itself).  Spark results round doubles to
6 places; the oracle SQL does the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import clean, quality, reports, reputation, trust, unify
from ..params import QualityParams, TrustParams, UNIFIED_COLUMNS
from ..sources import messages
from . import oracle as O
from . import testdata as td

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, doubles=()):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the harness's fixed times are UTC wall-clock, as in the oracle
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = O.round_doubles(sql, doubles)
        return fn
    return deco


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), places).alias(f.name)
                       if isinstance(f.dataType, DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def queries() -> dict[str, QueryFn]:
    _load_extensions()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_extensions()
    return dict(_SQL)


def _load_extensions():
    from . import catalog_forest, catalog_stream, catalog_windows  # noqa: F401


# ------------------------------------------------------------ shared frames
EV_FIELDS = UNIFIED_COLUMNS
EVQ = QualityParams.batch(completeness_fields=EV_FIELDS)
DIMS = ("completeness", "consistency", "accuracy", "freshness", "timeliness")


def scored_events(spark, sf_dir, as_of=td.EVENTS_AS_OF, flags=td.given_flags,
                  trust_params: TrustParams | None = None) -> DataFrame:
    """Events -> quality -> flag -> reputation -> trust (batch constants)."""
    f = td.events_feed(spark, sf_dir, as_of, with_key=True)
    q = flags(quality.compute_quality_metrics(f, EVQ, as_of))
    r = reputation.compute_source_reputation(q)
    return trust.compute_trust_score(r, trust_params or TrustParams.batch(),
                                     as_of)


SCORED = "WITH " + O.scored_events_sql()


# ------------------------------------------------------------ P1 flagship
@register("trust_by_source", SCORED + """
SELECT source_id, ROUND(AVG(trust_score), 2) AS avg_trust_score,
       ROUND(AVG(completeness), 3) AS avg_completeness,
       ROUND(AVG(accuracy), 3) AS avg_accuracy
FROM t GROUP BY source_id ORDER BY source_id""")
def q_trust_by_source(spark, sf_dir):
    return reports.trust_by_source(scored_events(spark, sf_dir))


# ------------------------------------------------------------ Q1-Q8
@register("quality_events", f"""
WITH f AS ({O.events_sql(True)})
SELECT row_key, {O.quality_sql("batch", td.EVENTS_AS_OF)} FROM f""", DIMS)
def q_quality_events(spark, sf_dir):
    f = td.events_feed(spark, sf_dir, with_key=True)
    return quality.compute_quality_metrics(f, EVQ, td.EVENTS_AS_OF).select(
        "row_key", *DIMS)


_SQ = QualityParams.streaming()


@register("quality_events_streaming", f"""
WITH f AS (SELECT row_key, user_id, amount AS purchase_amount, city,
                  "timestamp", source_id, ingestion_timestamp
           FROM ({O.events_sql(True)}))
SELECT row_key, {O.quality_sql("stream", td.EVENTS_AS_OF)} FROM f""", DIMS)
def q_quality_events_streaming(spark, sf_dir):
    f = td.events_feed(spark, sf_dir, with_key=True).withColumnRenamed(
        "amount", "purchase_amount")
    return quality.compute_quality_metrics(f, _SQ, td.EVENTS_AS_OF).select(
        "row_key", *DIMS)


@register("quality_orders", f"""
WITH f AS ({O.feed_sql(td.ORDERS, with_key=True, ingestion=O.ts_lit(td.TPCH_AS_OF))})
SELECT row_key, {O.quality_sql("batch", td.TPCH_AS_OF)} FROM f""", DIMS)
def q_quality_orders(spark, sf_dir):
    f = td.raw_feed(spark, sf_dir, td.ORDERS, with_key=True).withColumn(
        "ingestion_timestamp", F.lit(td.TPCH_AS_OF).cast("timestamp"))
    return quality.compute_quality_metrics(f, EVQ, td.TPCH_AS_OF).select(
        "row_key", *DIMS)


_ORDER_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
               "o_orderdate", "o_orderpriority")


@register("completeness_dynamic", """
WITH o AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  o_orderstatus,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)
SELECT o_orderkey, CAST((""" + " + ".join(
    f"(CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 END)" for c in _ORDER_COLS)
    + """) / 6 AS DOUBLE) AS completeness FROM o""", ("completeness",))
def q_completeness_dynamic(spark, sf_dir):
    """Q1 on a raw table: every column counts (none is derived)."""
    o = td.dirty_table(spark, sf_dir, td.ORDERS)
    out = quality.compute_quality_metrics(o, QualityParams.batch(
        amount_col="o_totalprice", timestamp_col="o_orderdate"), td.TPCH_AS_OF)
    return out.select("o_orderkey", "completeness")


@register("quality_score", SCORED + """
SELECT row_key, """ + O.QSUM + """ / 5.0::DOUBLE AS quality_score FROM t""",
          ("quality_score",))
def q_quality_score(spark, sf_dir):
    f = td.events_feed(spark, sf_dir, with_key=True)
    return quality.compute_quality_metrics(
        f, EVQ, td.EVENTS_AS_OF, with_score=True).select("row_key",
                                                        "quality_score")


# ------------------------------------------------------------ R1 / R4
@register("source_reputation", SCORED + """
SELECT row_key, source_id, source_reputation FROM t""", ("source_reputation",))
def q_source_reputation(spark, sf_dir):
    return scored_events(spark, sf_dir).select("row_key", "source_id",
                                               "source_reputation")


NULL_SOURCE = 19   # key % 19 = 0: source id missing (null-source edge case)


def _events_null_source(spark, sf_dir):
    f = td.events_feed(spark, sf_dir, with_key=True)
    return td.given_flags(f.withColumn("source_id", F.when(
        F.col("row_key") % NULL_SOURCE != 0, F.col("source_id"))))


_NS = f"""WITH f0 AS ({O.events_sql(True)}),
f AS (SELECT * REPLACE (CASE WHEN row_key % {NULL_SOURCE} = 0 THEN NULL
                        ELSE source_id END AS source_id) FROM f0),
q AS (SELECT *, {O.flags_sql()} FROM f),
r AS (SELECT source_id, CASE WHEN COUNT(*) > 0 THEN 1.0::DOUBLE -
        SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END)::DOUBLE / COUNT(*)
        ELSE 0.5::DOUBLE END AS source_reputation
      FROM q WHERE source_id IS NOT NULL GROUP BY source_id)"""


@register("reputation_default", _NS + """
SELECT q.row_key, q.source_id, r.source_reputation
FROM q LEFT JOIN r ON q.source_id = r.source_id""", ("source_reputation",))
def q_reputation_default(spark, sf_dir):
    """R4, including rows without a source (their reputation is null)."""
    out = reputation.compute_source_reputation_batch_reference(
        _events_null_source(spark, sf_dir))
    return out.select("row_key", "source_id", "source_reputation")


# ------------------------------------------------------------ T1-T4
@register("trust_score", SCORED + """
SELECT row_key, source_id, temporal_decay, trust_score FROM t""",
          ("temporal_decay", "trust_score"))
def q_trust_score(spark, sf_dir):
    return scored_events(spark, sf_dir).select("row_key", "source_id",
                                               "temporal_decay", "trust_score")


@register("trust_score_default", _NS + f""",
s0 AS (SELECT q.*, r.source_reputation
       FROM q LEFT JOIN r ON q.source_id = r.source_id),
s AS (SELECT *, {O.quality_sql("batch", td.EVENTS_AS_OF)} FROM s0)
SELECT row_key, source_id, source_reputation,
  {O.QSUM} / 5.0::DOUBLE * COALESCE(source_reputation, 0.5::DOUBLE)
  * exp(-0.05::DOUBLE * datediff('day', ingestion_timestamp, {O.ts_lit(td.EVENTS_AS_OF)}))
  * 100.0::DOUBLE AS trust_score FROM s""", ("source_reputation", "trust_score"))
def q_trust_score_default(spark, sf_dir):
    """The stream's trust, a missing reputation counting as 0.5."""
    f = reputation.compute_source_reputation_batch_reference(
        _events_null_source(spark, sf_dir))
    q = quality.compute_quality_metrics(f, EVQ, td.EVENTS_AS_OF)
    out = trust.compute_trust_score_streaming(q, td.EVENTS_AS_OF)
    return out.select("row_key", "source_id", "source_reputation",
                      "trust_score")


def _ingest_spread(row_key):
    """Ingestion 2 days after to 6 days before ``as_of``, by key."""
    return (F.lit(td.EVENTS_AS_OF).cast("timestamp")
            - F.make_dt_interval(days=(row_key % 9 - 2).cast("int")))


_SPREAD_SQL = (f"{O.ts_lit(td.EVENTS_AS_OF)} - "
               "to_days(CAST(row_key % 9 - 2 AS INTEGER))")


@register("temporal_decay", f"""
WITH f0 AS ({O.events_sql(True)}),
f AS (SELECT * REPLACE ({_SPREAD_SQL} AS ingestion_timestamp) FROM f0),
q AS (SELECT *, {O.quality_sql("batch", td.EVENTS_AS_OF)}, {O.flags_sql()} FROM f),
r AS (SELECT source_id, 1.0::DOUBLE - SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END)::DOUBLE
      / COUNT(*) AS source_reputation FROM q GROUP BY source_id),
s AS (SELECT q.*, r.source_reputation, exp(-0.05::DOUBLE * datediff('day',
        ingestion_timestamp, {O.ts_lit(td.EVENTS_AS_OF)})) AS temporal_decay
      FROM q LEFT JOIN r ON q.source_id = r.source_id)
SELECT row_key, timeliness, temporal_decay,
  {O.QSUM} / 5.0::DOUBLE * source_reputation * temporal_decay * 100.0::DOUBLE
  AS trust_score FROM s""", ("timeliness", "temporal_decay", "trust_score"))
def q_temporal_decay(spark, sf_dir):
    """T1 with ingestion times before and after ``as_of`` (decay > 1)."""
    f = td.events_feed(spark, sf_dir, with_key=True)
    f = f.withColumn("ingestion_timestamp", _ingest_spread(F.col("row_key")))
    q = td.given_flags(quality.compute_quality_metrics(f, EVQ, td.EVENTS_AS_OF))
    r = reputation.compute_source_reputation(q)
    out = trust.compute_trust_score(r, TrustParams.batch(), td.EVENTS_AS_OF)
    return out.select("row_key", "timeliness", "temporal_decay", "trust_score")


@register("trust_age_decay", SCORED.replace(
    "exp(-0.05::DOUBLE * datediff('day', q.ingestion_timestamp",
    "exp(-0.1::DOUBLE * datediff('day', q.\"timestamp\"") + f"""
SELECT row_key, {O.QSUM} / 5.0::DOUBLE AS quality_score,
  datediff('day', "timestamp", {O.ts_lit(td.EVENTS_AS_OF)}) AS days_old,
  temporal_decay, trust_score FROM t""",
          ("quality_score", "temporal_decay", "trust_score"))
def q_trust_age_decay(spark, sf_dir):
    """T4: decay exp(-0.1 * record age in days), with quality_score and
    days_old columns."""
    out = scored_events(spark, sf_dir, trust_params=TrustParams.age_decay())
    out = trust.compute_trust_score(out, TrustParams.age_decay(),
                                    td.EVENTS_AS_OF, with_quality_score=True,
                                    with_age=True)
    return out.select("row_key", "quality_score",
                      F.col("days_old").cast("long").alias("days_old"),
                      "temporal_decay", "trust_score")


# ------------------------------------------------------------ P2-P10
@register("quality_matrix", SCORED + """
SELECT source_id, AVG(completeness) AS avg_completeness,
  AVG(accuracy) AS avg_accuracy, AVG(freshness) AS avg_freshness,
  AVG(source_reputation) AS avg_reputation,
  CAST(SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS BIGINT) AS anomaly_count,
  AVG(trust_score) AS avg_trust FROM t GROUP BY source_id""",
          ("avg_completeness", "avg_accuracy", "avg_freshness",
           "avg_reputation", "avg_trust"))
def q_quality_matrix(spark, sf_dir):
    return reports.quality_matrix(scored_events(spark, sf_dir))


@register("radar_series", SCORED + """,
m AS (SELECT source_id, AVG(completeness) AS c, AVG(accuracy) AS a,
        AVG(freshness) AS f, AVG(source_reputation) AS r FROM t GROUP BY source_id)
SELECT source_id, 0 AS point, 'Completeness' AS metric, c * 100.0::DOUBLE AS value FROM m
UNION ALL SELECT source_id, 1, 'Accuracy', a * 100.0::DOUBLE FROM m
UNION ALL SELECT source_id, 2, 'Freshness', f * 100.0::DOUBLE FROM m
UNION ALL SELECT source_id, 3, 'Reputation', r * 100.0::DOUBLE FROM m
UNION ALL SELECT source_id, 4, 'Completeness', c * 100.0::DOUBLE FROM m""",
          ("value",))
def q_radar_series(spark, sf_dir):
    return reports.radar_series(reports.quality_matrix(
        scored_events(spark, sf_dir)))


@register("trust_summary", SCORED + """
SELECT COUNT(*) AS total_records,
  ROUND(COALESCE(AVG(completeness), 0) * 100.0::DOUBLE, 2) AS completeness,
  ROUND(COALESCE(AVG(accuracy), 0) * 100.0::DOUBLE, 2) AS accuracy,
  ROUND(SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) * 100.0::DOUBLE, 2)
    AS anomaly_rate,
  ROUND(COALESCE(AVG(source_reputation), 0) * 100.0::DOUBLE, 2) AS reputation,
  ROUND(COALESCE(AVG(trust_score), 0), 2) AS trust_score
FROM t HAVING COUNT(*) > 0""")
def q_trust_summary(spark, sf_dir):
    return reports.trust_summary(scored_events(spark, sf_dir))


@register("top_anomalies", SCORED + """
SELECT user_id, source_id, amount, trust_score, anomaly_severity FROM t
WHERE is_anomaly
ORDER BY anomaly_severity DESC NULLS LAST, user_id ASC NULLS LAST,
  source_id ASC NULLS LAST, amount ASC NULLS LAST, trust_score ASC NULLS LAST
LIMIT 10""", ("amount", "trust_score", "anomaly_severity"))
def q_top_anomalies(spark, sf_dir):
    """P5: the 10 most severe flagged rows (the limit is the report)."""
    return reports.top_anomalies(scored_events(spark, sf_dir), 10)


@register("trust_bands", SCORED + """
SELECT CASE WHEN trust_score >= 80 THEN 'High Trust'
            WHEN trust_score >= 50 THEN 'Moderate Trust'
            ELSE 'Critical Risk' END AS trust_band, COUNT(*) AS records
FROM t GROUP BY 1""")
def q_trust_bands(spark, sf_dir):
    return reports.trust_bands(scored_events(spark, sf_dir))


@register("anomaly_alerts", SCORED + """
SELECT source_id, COUNT(*) AS records,
  CAST(SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS BIGINT) AS anomalies,
  CAST(SUM(CASE WHEN is_anomaly AND anomaly_severity > 0.8 THEN 1 ELSE 0 END) AS BIGINT)
    AS high_severity,
  CAST(SUM(CASE WHEN is_anomaly AND NOT anomaly_severity > 0.8 THEN 1 ELSE 0 END) AS BIGINT)
    AS medium_severity,
  SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) AS anomaly_rate,
  SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) > 0.05 AS rate_alert
FROM t GROUP BY source_id""", ("anomaly_rate",))
def q_anomaly_alerts(spark, sf_dir):
    return reports.anomaly_alerts(scored_events(spark, sf_dir))


@register("record_count", f"SELECT COUNT(*) AS records FROM events")
def q_record_count(spark, sf_dir):
    return reports.record_count(td.table(spark, sf_dir, "events"))


# ------------------------------------------------------------ U14 / U15
@register("output_short", SCORED + """
SELECT user_id, source_id, "timestamp", is_anomaly, source_reputation,
  trust_score FROM t""", ("source_reputation", "trust_score"))
def q_output_short(spark, sf_dir):
    return clean.prepare_output_columns(scored_events(spark, sf_dir))


@register("output_multi", SCORED + """
SELECT user_id, source_id, amount, city, completeness, consistency, accuracy,
  freshness, timeliness, is_anomaly, source_reputation, temporal_decay,
  trust_score FROM t""", ("amount",) + DIMS + ("source_reputation",
                                               "temporal_decay", "trust_score"))
def q_output_multi(spark, sf_dir):
    return clean.final_projection(scored_events(spark, sf_dir), True)


@register("output_single", SCORED + """
SELECT user_id, source_id, completeness, consistency, accuracy, freshness,
  timeliness, is_anomaly, source_reputation, temporal_decay, trust_score
FROM t""", DIMS + ("source_reputation", "temporal_decay", "trust_score"))
def q_output_single(spark, sf_dir):
    return clean.final_projection(scored_events(spark, sf_dir), False)


@register("output_full", SCORED + """
SELECT user_id, source_id, amount AS purchase_amount, city, "timestamp",
  completeness, consistency, accuracy, freshness, timeliness, is_anomaly,
  anomaly_severity, source_reputation, temporal_decay, trust_score
FROM t""", ("purchase_amount",) + DIMS + (
    "anomaly_severity", "source_reputation", "temporal_decay", "trust_score"))
def q_output_full(spark, sf_dir):
    """U14 with the intermediate columns."""
    s = scored_events(spark, sf_dir).withColumnRenamed("amount",
                                                       "purchase_amount")
    return clean.prepare_output_columns(s, include_intermediate=True)


# ------------------------------------------------------------ unification
def _four_sql(as_of=td.EVENTS_AS_OF):
    parts = [O.feed_sql(td.FEEDS[n], tag=n) for n in td.FOUR]
    return " UNION ALL ".join(f"({p})" for p in parts)


_UNIFIED_SQL = f"""
WITH u AS ({_four_sql()})
SELECT user_id, amount, COALESCE(city, 'unknown') AS city, "timestamp",
  source_id, {O.ts_lit(td.EVENTS_AS_OF)} AS ingestion_timestamp
FROM u WHERE amount IS NOT NULL AND amount > 0 AND "timestamp" IS NOT NULL"""


@register("unify_feeds", _UNIFIED_SQL, ("amount",))
def q_unify_feeds(spark, sf_dir):
    """U1-U6 / X1 / F1 over four feeds."""
    return unify.clean_unified(unify.unify_feeds(td.four_feeds(spark, sf_dir)),
                               td.EVENTS_AS_OF)


@register("feed_counts", f"""
SELECT source_id, COUNT(*) AS count FROM ({_UNIFIED_SQL}) GROUP BY source_id
ORDER BY source_id""")
def q_feed_counts(spark, sf_dir):
    """U7 / P6."""
    return unify.feed_counts(q_unify_feeds(spark, sf_dir))


def _strict_mappings():
    return {
        "orders": td.mapping(td.ORDERS, defaults={"city": "unknown"}),
        "lineitem": td.mapping(td.LINEITEM, constants={"city": "NYC"}),
        "events": td.mapping(td.EVENTS),
        "customer": td.mapping(td.CUSTOMER),
    }


@register("unify_strict", f"""
WITH o AS ({O.feed_sql(td.ORDERS)}), l AS ({O.feed_sql(td.LINEITEM)}),
e AS ({O.feed_sql(td.EVENTS)}), c AS ({O.feed_sql(td.CUSTOMER)}),
u AS (
  SELECT user_id, amount, COALESCE(city, 'unknown') AS city, "timestamp", source_id FROM o
  UNION ALL SELECT user_id, amount, 'NYC', "timestamp", source_id FROM l
  UNION ALL SELECT * FROM e UNION ALL SELECT * FROM c)
SELECT * FROM u WHERE user_id IS NOT NULL AND amount IS NOT NULL
  AND city IS NOT NULL AND "timestamp" IS NOT NULL AND source_id IS NOT NULL""",
          ("amount",))
def q_unify_strict(spark, sf_dir):
    """U8 / F2: defaults, then rows with any null dropped, per feed."""
    maps = _strict_mappings()
    frames = [unify.unify_strict(td.dirty_table(spark, sf_dir, td.FEEDS[n]),
                                 maps[n]) for n in td.FOUR]
    return unify.unify_feeds(frames)


@register("unify_permissive", f"""
WITH o AS ({O.feed_sql(td.ORDERS)}), l AS ({O.feed_sql(td.LINEITEM)}),
u AS (
  SELECT user_id, amount, 'missing_city' AS city, "timestamp", 'unknown' AS source_id FROM o
  UNION ALL SELECT 'missing_user_id', amount, city, "timestamp", source_id FROM l)
SELECT * FROM u WHERE user_id IS NOT NULL AND amount IS NOT NULL
  AND "timestamp" IS NOT NULL""", ("amount",))
def q_unify_permissive(spark, sf_dir):
    """Orders without a mapping (tag ``unknown``, columns taken by
    their unified names) and lineitem whose user column is absent."""
    o = td.dirty_table(spark, sf_dir, td.ORDERS).select(
        F.col("o_custkey").alias("USER_ID"), F.col("o_totalprice").alias("Amount"),
        F.col("o_orderdate").alias("Timestamp"))
    l_map = td.mapping(td.LINEITEM, columns={"user_id": "no_such_column"})
    li = td.dirty_table(spark, sf_dir, td.LINEITEM)
    return unify.unify_feeds([unify.unify_permissive(o, None),
                              unify.unify_permissive(li, l_map)])


def _with_headers(spark, sf_dir, feed, names):
    """A harness feed's user, amount, city and timestamp as text columns of
    a file with those headers (None: the file lacks the column)."""
    df = td.dirty_table(spark, sf_dir, feed)
    cols = (feed.user_id, feed.amount, feed.city, feed.timestamp)
    return df.select(*[F.col(c).cast("string").alias(n)
                       for c, n in zip(cols, names) if n])


@register("unify_loader_files", f"""
WITH u AS ({O.feed_sql(td.ORDERS, tag="transactions")}
  UNION ALL {O.feed_sql(td.LINEITEM, tag="ecommerce")}
  UNION ALL {O.feed_sql(td.EVENTS, tag="subscription")}
  UNION ALL {O.feed_sql(td.CUSTOMER_FEED, tag="taxi")})
SELECT user_id, amount, COALESCE(city, 'unknown') AS city, "timestamp",
  source_id, {O.ts_lit(td.EVENTS_AS_OF)} AS ingestion_timestamp
FROM u WHERE amount IS NOT NULL AND amount > 0 AND "timestamp" IS NOT NULL""",
          ("amount",))
def q_unify_loader_files(spark, sf_dir):
    """U1-U6 with the loader mappings: all-text files in their headers."""
    from ..sources.feeds import ECOMMERCE, SUBSCRIPTION, TAXI, TRANSACTIONS
    feeds = [(td.ORDERS, TRANSACTIONS), (td.LINEITEM, ECOMMERCE),
             (td.EVENTS, SUBSCRIPTION), (td.CUSTOMER_FEED, TAXI)]
    heads = ("user_id", "amount", "city", "timestamp")
    return unify.load_all_sources(
        [(_with_headers(spark, sf_dir, f, [m.columns[h] for h in heads]), m)
         for f, m in feeds], td.EVENTS_AS_OF)


@register("unify_strict_files", f"""
WITH u AS (
  SELECT user_id, amount, city, "timestamp", 'transactions' AS source_id
    FROM ({O.feed_sql(td.ORDERS)})
  UNION ALL SELECT user_id, amount, COALESCE(city, 'unknown'), "timestamp",
    'subscription' FROM ({O.feed_sql(td.EVENTS)})
  UNION ALL SELECT user_id, amount, 'NYC', "timestamp", 'taxi'
    FROM ({O.feed_sql(td.CUSTOMER_FEED)}))
SELECT * FROM u WHERE user_id IS NOT NULL AND amount IS NOT NULL
  AND city IS NOT NULL AND "timestamp" IS NOT NULL""", ("amount",))
def q_unify_strict_files(spark, sf_dir):
    """U8 with the strict mappings (the generated ids of the fourth one
    are ``surrogate_ids``)."""
    from ..sources.feeds import STRICT_MAPPINGS
    m = {x.name: x for x in STRICT_MAPPINGS}
    feeds = [(td.ORDERS, m["transactions"],
              ("user_id", "purchase_amount", "city", "timestamp")),
             (td.EVENTS, m["subscription"],
              ("user_uuid", "monthly_billing", "city_name", "created_at")),
             (td.CUSTOMER_FEED, m["taxi"],
              ("passenger_id", "fare_amount", None, "trip_timestamp"))]
    return unify.unify_feeds([unify.unify_strict(
        _with_headers(spark, sf_dir, f, h), x) for f, x, h in feeds])


@register("unify_permissive_files", f"""
WITH o AS ({O.feed_sql(td.ORDERS)}), l AS ({O.feed_sql(td.LINEITEM)}),
e AS ({O.feed_sql(td.EVENTS)}),
u AS (
  SELECT user_id, amount, city, "timestamp", 'ecommerce' AS source_id FROM o
  UNION ALL SELECT user_id, amount, 'unknown', "timestamp", 'subscriptions'
    FROM l
  UNION ALL SELECT user_id, amount, city, "timestamp", 'taxi' FROM e
  UNION ALL SELECT user_id, amount, COALESCE(city, 'unknown'), "timestamp",
    'transactions' FROM o)
SELECT * FROM u WHERE user_id IS NOT NULL AND amount IS NOT NULL
  AND "timestamp" IS NOT NULL""", ("amount",))
def q_unify_permissive_files(spark, sf_dir):
    """U10 over the four file mappings, picked by file name: headers as the
    files have them, the last file already in unified names."""
    from ..sources.feeds import mapping_for_file

    def feed(feed, file, names):
        df = td.dirty_table(spark, sf_dir, feed)
        cols = (feed.user_id, feed.amount, feed.city, feed.timestamp)
        df = df.select(*[F.col(c).alias(n) for c, n in zip(cols, names)
                         if n])
        return unify.unify_permissive(df, mapping_for_file(file))
    return unify.unify_feeds([
        feed(td.ORDERS, "raw/ecommerce_data.csv",
             ("Customer_ID", "Purchase_Amount", "Location", "Purchase_Time")),
        feed(td.LINEITEM, "raw/subscription_data.csv",
             ("subscriber_id", "monthly_fee", None, "signup_date")),
        feed(td.EVENTS, "raw/taxi_data.csv",
             ("user_id", "fare_amount", "pickup_location", "pickup_time")),
        feed(td.ORDERS, "raw/transactions.csv",
             ("user_id", "amount", "city", "timestamp"))])


ADAPT_SQL = f"""
WITH c AS (SELECT
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey END AS amount, c_name,
  c_nationkey,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)
SELECT amount, c_name, c_nationkey, c_acctbal, c_mktsegment,
  'user_upload' AS source_id, 'unknown' AS user_id, 'unknown' AS city,
  {O.ts_lit(td.TPCH_AS_OF)} AS "timestamp",
  CAST(((CASE WHEN amount IS NULL THEN 0.0 ELSE 1.0 END) +
   (CASE WHEN c_acctbal IS NULL THEN 0.0 ELSE 1.0 END) +
   (CASE WHEN c_mktsegment IS NULL THEN 0.0 ELSE 1.0 END) + 6.0) / 9 AS DOUBLE)
   AS completeness,
  CAST(CASE WHEN amount IS NULL THEN 0.0 WHEN amount >= 0 AND amount <= 100000
   THEN 1.0 ELSE 0.0 END AS DOUBLE) AS accuracy
FROM c"""


@register("adapt_schema", ADAPT_SQL, ("c_acctbal", "completeness", "accuracy"))
def q_adapt_schema(spark, sf_dir):
    """U11 on customer: the first numeric column becomes the amount; then
    dynamic completeness over the adapted columns."""
    c = td.dirty_table(spark, sf_dir, td.CUSTOMER)
    a = unify.adapt_schema(c, td.TPCH_AS_OF)
    scored = quality.compute_quality_metrics(a, QualityParams.batch(),
                                             td.TPCH_AS_OF)
    return scored.select(F.col("amount").cast("long").alias("amount"),
                         "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
                         "source_id", "user_id", "city", "timestamp",
                         "completeness", "accuracy")


# ------------------------------------------------------------ U12 / U13
BAD_AMOUNT = 29     # key % 29 = 0: unparsable amount text


def raw_text_events(spark, sf_dir) -> DataFrame:
    """Events as the producer's CSV rows: all text, blanks for nulls."""
    e = td.table(spark, sf_dir, "events")
    k = F.col("event_id")
    blank = lambda m, v: F.when(k % m == 0, F.lit("")).otherwise(v)
    amount = F.when(k % BAD_AMOUNT == 0, F.lit("abc")).otherwise(
        blank(td.NULL_AMOUNT, F.col("value").cast("string")))
    return e.select(
        k.alias("row_index"),
        blank(td.NULL_USER, F.concat(F.lit(" "), F.col("user_id").cast("string"),
                                     F.lit(" "))).alias("user_id"),
        amount.alias("purchase_amount"),
        blank(td.NULL_CITY, F.get_json_object("props", "$.k")).alias("city"),
        blank(td.NULL_TIMESTAMP, F.date_format(
            "ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.col("event_type").alias("source_id"))


_RAW_TEXT_SQL = f"""
WITH r AS (SELECT event_id AS row_index,
  CASE WHEN event_id % {td.NULL_USER} = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id,
  CASE WHEN event_id % {BAD_AMOUNT} = 0 THEN NULL
       WHEN event_id % {td.NULL_AMOUNT} = 0 THEN NULL ELSE value END AS purchase_amount,
  CASE WHEN event_id % {td.NULL_CITY} = 0 THEN '' ELSE json_extract_string(props, '$.k') END AS city,
  CASE WHEN event_id % {td.NULL_TIMESTAMP} = 0 THEN ''
       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS "timestamp",
  event_type AS source_id FROM events)"""


@register("clean_records", _RAW_TEXT_SQL + """
SELECT row_index, user_id, source_id, "timestamp", city, purchase_amount
FROM r WHERE length(user_id) > 0 AND length("timestamp") > 0""",
          ("purchase_amount",))
def q_clean_records(spark, sf_dir):
    """Trimmed, parsed, rows with a user id and timestamp."""
    return clean.clean_records(raw_text_events(spark, sf_dir),
                               keep=("row_index",))


@register("clean_rejects", _RAW_TEXT_SQL + """
SELECT row_index, user_id, source_id, "timestamp", city, purchase_amount,
  CASE WHEN length(user_id) = 0 THEN 'no_user_id'
       ELSE 'no_timestamp' END AS reject_reason
FROM r WHERE NOT (length(user_id) > 0 AND length("timestamp") > 0)""",
          ("purchase_amount",))
def q_clean_rejects(spark, sf_dir):
    return clean.reject_records(raw_text_events(spark, sf_dir),
                                keep=("row_index",))


REPLAY_START, REPLAY_MAX = 1000, 5000


@register("replay_slice", _RAW_TEXT_SQL + f"""
SELECT row_index, user_id, source_id, "timestamp", city, purchase_amount
FROM r WHERE row_index >= {REPLAY_START} AND length(user_id) > 0
  AND length("timestamp") > 0 ORDER BY row_index LIMIT {REPLAY_MAX}""",
          ("purchase_amount",))
def q_replay_slice(spark, sf_dir):
    """Skip the first rows, then replay a fixed number of good ones
    (the slice is the operator)."""
    return clean.replay_slice(raw_text_events(spark, sf_dir), "row_index",
                              REPLAY_START, REPLAY_MAX)


FILE_START, FILE_MAX = 137, 6000


@register("replay_file", _RAW_TEXT_SQL + f"""
SELECT n AS row_number, user_id, source_id, "timestamp", city, purchase_amount
FROM (SELECT *, row_number() OVER (ORDER BY row_index) - 1 AS n FROM r)
WHERE n >= {FILE_START} AND length(user_id) > 0
  AND length("timestamp") > 0 ORDER BY n LIMIT {FILE_MAX}""",
          ("purchase_amount",))
def q_replay_file(spark, sf_dir):
    """U13 from plain CSV files: rows numbered as they stand in them, then
    the slice.  The files are the events in order, in several parts."""
    from ..session import scratch_path
    from ..sources import files
    path = scratch_path(spark, "replay-csv")
    (raw_text_events(spark, sf_dir).repartitionByRange(5, "row_index")
     .sortWithinPartitions("row_index").drop("row_index")
     .write.option("header", "true").option("emptyValue", "").csv(path))
    rows = files.read_csv_rows(spark, path)
    return clean.replay_slice(rows, "row_number", FILE_START, FILE_MAX)


# ------------------------------------------------------------ S11/S12/S14
MALFORMED, WRONG_TYPE = 19, 23


@register("json_roundtrip", f"""
WITH e AS ({O.events_sql(True)})
SELECT row_key,
  CASE WHEN row_key % {MALFORMED} = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN row_key % {MALFORMED} = 0 OR row_key % {WRONG_TYPE} = 0 THEN NULL
       ELSE amount END AS purchase_amount,
  CASE WHEN row_key % {MALFORMED} = 0 THEN NULL ELSE city END AS city,
  CASE WHEN row_key % {MALFORMED} = 0 THEN NULL ELSE "timestamp" END AS "timestamp",
  CASE WHEN row_key % {MALFORMED} = 0 THEN NULL ELSE source_id END AS source_id
FROM e""", ("purchase_amount",))
def q_json_roundtrip(spark, sf_dir):
    """S14 encode -> damaged in transit -> S11 parse -> S12 timestamps."""
    e = td.events_feed(spark, sf_dir, with_key=True)
    rec = e.select("row_key", "user_id",
                   F.when(F.col("row_key") % WRONG_TYPE == 0, F.lit("x"))
                   .otherwise(F.col("amount").cast("string"))
                   .alias("purchase_amount_text"), "amount", "city",
                   "timestamp", "source_id")
    good = rec.withColumnRenamed("amount", "purchase_amount").drop(
        "purchase_amount_text")
    msgs = messages.encode_messages(good, key_col="user_id",
                                    keep=("row_key",))
    # Damage in transit: a truncated body, or a text where a number goes.
    wrong = F.regexp_replace(F.col("value"), r'"purchase_amount":[^,}]*',
                             '"purchase_amount":"x"')
    msgs = msgs.withColumn("value", F.when(
        F.col("row_key") % MALFORMED == 0, F.lit("{bad"))
        .when(F.col("row_key") % WRONG_TYPE == 0, wrong)
        .otherwise(F.col("value")))
    parsed = messages.parse_messages(msgs, keep=("row_key",))
    out = messages.prepare_ingestion_fields(parsed, as_of=td.EVENTS_AS_OF)
    return out.select("row_key", "user_id", "purchase_amount", "city",
                      "timestamp", "source_id")


@register("feed_directory", f"""
WITH o AS ({O.feed_sql(td.ORDERS)}), l AS ({O.feed_sql(td.LINEITEM)}),
c AS ({O.feed_sql(td.CUSTOMER_FEED)}),
u AS (
  SELECT user_id, amount, city, "timestamp", 'ecommerce' AS source_id FROM o
  UNION ALL SELECT user_id, amount, 'unknown', "timestamp", 'subscriptions'
    FROM l
  UNION ALL SELECT user_id, amount, city, "timestamp", 'taxi' FROM c)
SELECT * FROM u WHERE user_id IS NOT NULL AND amount IS NOT NULL
  AND "timestamp" IS NOT NULL""", ("amount",))
def q_feed_directory(spark, sf_dir):
    """S4 + U10: a folder of CSV files, each mapped by its name; files of
    one mapping with columns in another order, and with one more."""
    from ..session import scratch_path
    from ..sources import files
    from ..sources.feeds import PERMISSIVE_MAPPINGS
    folder = scratch_path(spark, "feeds")
    for feed, name, heads, parts in (
            (td.ORDERS, "ecommerce", ("customer_id", "purchase_amount",
                                      "location", "purchase_time"), 3),
            (td.LINEITEM, "subscription", ("subscriber_id", "monthly_fee",
                                           "city", "signup_date"), 2),
            (td.CUSTOMER_FEED, "taxi", ("user_id", "fare_amount",
                                        "pickup_location", "pickup_time"), 1)):
        df = td.dirty_table(spark, sf_dir, feed).withColumn(
            "part", F.pmod(F.expr(feed.key), F.lit(parts)))
        cols = (feed.user_id, feed.amount, feed.city, feed.timestamp)
        named = [F.col(c).alias(n) for c, n in zip(cols, heads)]
        for k, heading in enumerate((named, named[::-1],
                                     [F.lit("x").alias("extra"), *named])):
            if k < parts:
                df.where(F.col("part") == k).select(*heading).write.option(
                    "header", "true").csv(f"{folder}/{name}_{k}.csv")
    return unify.unify_feeds([
        unify.unify_permissive(df, m) for df, m in files.read_feed_directory(
            spark, folder, PERMISSIVE_MAPPINGS)])


@register("surrogate_ids", f"""
WITH l AS ({O.feed_sql(td.LINEITEM)})
SELECT COUNT(*) AS records, COUNT(*) AS ids, COUNT(*) AS same_again FROM l
WHERE amount IS NOT NULL AND "timestamp" IS NOT NULL""")
def q_surrogate_ids(spark, sf_dir):
    """Generated ids are unique and the same when generated again."""
    from ..sources.feeds import STRICT_MAPPINGS
    ecommerce = next(m for m in STRICT_MAPPINGS if m.name == "ecommerce")
    li = td.dirty_table(spark, sf_dir, td.LINEITEM).select(
        F.col("l_extendedprice").alias("order_value"),
        F.col("l_returnflag").alias("location"),
        F.col("l_shipdate").alias("order_date"))
    a = unify.unify_strict(li, ecommerce)
    b = unify.unify_strict(li.repartition(7), ecommerce)
    both = a.select("user_id").join(b.select("user_id"), "user_id")
    return a.agg(F.count("*").alias("records"),
                 F.countDistinct("user_id").alias("ids")).join(
        both.agg(F.count("*").alias("same_again")))


# ------------------------------------------------------------ X2, P8, S3
@register("append_union", " UNION ALL ".join(
    f"({O.feed_sql(td.FEEDS[n], tag=n)})" for n in td.FOUR), ("amount",))
def q_append_union(spark, sf_dir):
    """The first feed overwrites a Parquet folder, the others
    append, then the folder is read back (types aligned before writing)."""
    from ..session import scratch_path
    from ..sources import files
    return files.append_feeds(td.four_feeds(spark, sf_dir),
                              scratch_path(spark, "append-union"))


EXACT_N = 1000


@register("exact_sample", f"""
WITH e AS ({O.events_sql(True)})
SELECT row_key, source_id, amount FROM e
ORDER BY CAST(('0x' || substr(md5(CAST(row_key AS VARCHAR) || '#42'), 1, 8)) AS BIGINT),
  row_key LIMIT {EXACT_N}""", ("amount",))
def q_exact_sample(spark, sf_dir):
    """Exactly n rows, those with the smallest key hashes (the sample
    size is the operator)."""
    e = td.events_feed(spark, sf_dir, with_key=True)
    return reports.exact_sample(e, EXACT_N, ["row_key"], 42, "md5").select(
        "row_key", "source_id", "amount")


@register("csv_upload_quality", ADAPT_SQL,
          ("c_acctbal", "completeness", "accuracy"))
def q_csv_upload_quality(spark, sf_dir):
    """Customer written as CSV with a ``NULL`` token, read
    back with header and inferred types, adapted and scored."""
    from ..session import scratch_path
    from ..sources import files
    path = scratch_path(spark, "upload-csv")
    (td.dirty_table(spark, sf_dir, td.CUSTOMER).write.mode("overwrite")
     .option("header", "true").option("nullValue", "NULL").csv(path))
    raw = files.read_csv(spark, path, null_value="NULL", infer=True)
    a = unify.adapt_schema(raw, td.TPCH_AS_OF)
    scored = quality.compute_quality_metrics(a, QualityParams.batch(),
                                             td.TPCH_AS_OF)
    return scored.select(F.col("amount").cast("long").alias("amount"),
                         "c_name", F.col("c_nationkey").cast("int")
                         .alias("c_nationkey"), "c_acctbal", "c_mktsegment",
                         "source_id", "user_id", "city", "timestamp",
                         "completeness", "accuracy")
