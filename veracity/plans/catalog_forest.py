"""Forest queries: the hash sample and median, the fitted forest (grown
again by a recursive SQL query), and what is scored with it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.hashing import key_hash
from ..operators import forest, quality, reports, reputation, trust
from ..operators.lookup import materialize
from ..params import ForestParams, TrustParams
from ..session import scratch_path
from . import oracle as O
from . import testdata as td
from .catalog import EVQ, register

SAMPLE_FRACTION = 0.1
_CUT = int(round(SAMPLE_FRACTION * 2 ** 32))
_MD5_SQL = (f"CAST(('0x' || substr(md5(CAST(row_key AS VARCHAR) || '#42'), 1, 8))"
            f" AS BIGINT)")


def _md5_sample(spark, sf_dir):
    e = td.events_feed(spark, sf_dir, with_key=True)
    return e.where(key_hash(["row_key"], 42, "md5") < F.lit(_CUT))


@register("hash_sample", f"""
WITH e AS ({O.events_sql(True)})
SELECT row_key, source_id, amount FROM e WHERE {_MD5_SQL} < {_CUT}""",
          ("amount",))
def q_hash_sample(spark, sf_dir):
    """A 10 % sample decided by md5 of the row key."""
    return _md5_sample(spark, sf_dir).select("row_key", "source_id", "amount")


@register("median_impute", f"""
WITH e AS ({O.events_sql(True)}),
m AS (SELECT quantile_cont(amount, 0.5) AS med FROM e WHERE {_MD5_SQL} < {_CUT})
SELECT row_key, COALESCE(amount, m.med) AS amount FROM e, m""", ("amount",))
def q_median_impute(spark, sf_dir):
    """A2: nulls take the median of the training sample."""
    sample = _md5_sample(spark, sf_dir).select(F.col("amount").alias("x"))
    med = forest.sample_median(sample)
    e = td.events_feed(spark, sf_dir, with_key=True)
    return e.select("row_key", F.coalesce("amount", F.lit(med)).alias("amount"))


# ------------------------------------------------------------ the forest
def events_forest(spark, sf_dir, params: ForestParams | None = None):
    e = td.events_feed(spark, sf_dir, with_key=True)
    p = params or ForestParams(key_cols=("row_key",))
    return e, forest.fit_isolation_forest(e, p)


# The same forest in SQL: the sample of at least 256 rows, 256 per tree by
# a mix of key hash and tree number, cuts from md5(seed|tree|node).
FOREST_CTES = f"""
e AS ({O.events_sql(True)}),
h AS (SELECT row_key, amount, {_MD5_SQL} AS h FROM e),
smp AS (SELECT h, amount FROM (SELECT *, row_number() OVER (
          ORDER BY h, amount) AS rk FROM h) WHERE h < {_CUT} OR rk <= 256),
med AS (SELECT quantile_cont(amount, 0.5) AS m FROM smp),
xs AS (SELECT h, COALESCE(amount, m) AS x FROM smp, med),
th AS (SELECT t, h, x, ((h % 2147483629 + t * 7919)
         * (h % 2147483587 + t * 104729)) % 4294967291 AS th
       FROM xs, range(100) AS r(t)),
pts AS (SELECT t, x FROM (SELECT *, row_number() OVER (
          PARTITION BY t ORDER BY th, h, x) AS r FROM th) WHERE r <= 256),
g AS (
  SELECT t, 1::BIGINT AS node, 0 AS d, x, '-inf'::DOUBLE AS lo,
         'inf'::DOUBLE AS hi FROM pts
  UNION ALL
  SELECT t, node * 2 + (CASE WHEN x > cut THEN 1 ELSE 0 END), d + 1, x,
         CASE WHEN x > cut THEN cut ELSE lo END,
         CASE WHEN x > cut THEN hi ELSE cut END
  FROM (SELECT *, CASE WHEN c0 >= mx THEN mn ELSE c0 END AS cut FROM (
    SELECT *, mn + (('0x' || substr(md5('42|' || t || '|' || node), 1, 8))
                    ::BIGINT / 4294967296.0::DOUBLE) * (mx - mn) AS c0
    FROM (SELECT *, min(x) OVER w AS mn, max(x) OVER w AS mx,
                 count(*) OVER w AS c FROM g
          WINDOW w AS (PARTITION BY t, node))))
  WHERE c > 1 AND mn < mx AND d < 8),
leaves AS (
  SELECT t, lo, hi, d + CASE WHEN c <= 1 THEN 0 WHEN c = 2 THEN 1 ELSE
    2 * (ln(c - 1.0::DOUBLE) + 0.5772156649015329) - 2 * (c - 1.0::DOUBLE) / c
    END AS depth
  FROM (SELECT t, node, any_value(d) AS d, any_value(lo) AS lo,
               any_value(hi) AS hi, count(*)::DOUBLE AS c, min(x) AS mn,
               max(x) AS mx FROM g GROUP BY t, node)
  WHERE NOT (c > 1 AND mn < mx AND d < 8)),
vals AS (SELECT DISTINCT COALESCE(amount, 0.0::DOUBLE) AS x FROM e
         UNION SELECT x FROM xs),
deep AS (SELECT v.x, round(avg(l.depth), 9) AS depth
         FROM (SELECT x, t FROM vals, range(100) AS r(t)) AS v
         ASOF JOIN leaves AS l ON v.t = l.t AND v.x <= l.hi GROUP BY v.x),
sc AS (SELECT x, round(pow(2.0::DOUBLE, -depth / (2 * (ln(255.0::DOUBLE)
         + 0.5772156649015329) - 2 * 255.0::DOUBLE / 256)), 12) AS score
       FROM deep),
thr AS (SELECT quantile_cont(score, 0.95) AS t FROM xs JOIN sc USING (x)),
flags AS (SELECT e.row_key, sc.score > thr.t AS is_anomaly,
            sc.score - thr.t AS anomaly_severity
          FROM e JOIN sc ON sc.x = COALESCE(e.amount, 0.0::DOUBLE), thr)"""
FOREST_SCORED = f"WITH RECURSIVE {FOREST_CTES}, " + O.scored_events_sql(
    flags="flags")


@register("isolation_forest", f"""WITH RECURSIVE {FOREST_CTES}
SELECT row_key, source_id, amount, is_anomaly, anomaly_severity
FROM e JOIN flags USING (row_key)""", ("amount", "anomaly_severity"))
def q_isolation_forest(spark, sf_dir):
    """Fit on a 10 % hash sample, flag every event."""
    e, model = events_forest(spark, sf_dir)
    return model.transform(e).select("row_key", "source_id", "amount",
                                     "is_anomaly", "anomaly_severity")


@register("isolation_forest_model", f"""WITH RECURSIVE {FOREST_CTES}
SELECT t::BIGINT AS tree, lo, hi, depth FROM leaves""",
          ("lo", "hi", "depth"))
def q_isolation_forest_model(spark, sf_dir):
    """The model table (tree, lo, hi, depth)."""
    _, model = events_forest(spark, sf_dir)
    return model.leaves_frame(spark)


def forest_scored(spark, sf_dir, as_of=td.EVENTS_AS_OF):
    """The reference's batch job on events: quality, forest flags,
    reputation, decay, trust."""
    e, model = events_forest(spark, sf_dir)
    q = quality.compute_quality_metrics(e, EVQ, as_of)
    r = reputation.compute_source_reputation(model.transform(q))
    return trust.compute_trust_score(r, TrustParams.batch(), as_of)


@register("trust_by_source_forest", FOREST_SCORED + """
SELECT source_id, ROUND(AVG(trust_score), 2) AS avg_trust_score,
       ROUND(AVG(completeness), 3) AS avg_completeness,
       ROUND(AVG(accuracy), 3) AS avg_accuracy
FROM t GROUP BY source_id ORDER BY source_id""")
def q_trust_by_source_forest(spark, sf_dir):
    """P1 over forest-scored events."""
    return reports.trust_by_source(forest_scored(spark, sf_dir))


@register("top_anomalies_forest", FOREST_SCORED + """
SELECT user_id, source_id, amount, trust_score, anomaly_severity FROM t
WHERE is_anomaly
ORDER BY anomaly_severity DESC NULLS LAST, user_id ASC NULLS LAST,
  source_id ASC NULLS LAST, amount ASC NULLS LAST, trust_score ASC NULLS LAST
LIMIT 10""", ("amount", "trust_score", "anomaly_severity"))
def q_top_anomalies_forest(spark, sf_dir):
    """P5 over forest-scored events (the top 10 is the report)."""
    return reports.top_anomalies(forest_scored(spark, sf_dir), 10)


@register("train_model_store", f"""WITH RECURSIVE {FOREST_CTES}
SELECT row_key, is_anomaly, anomaly_severity FROM flags""",
          ("anomaly_severity",))
def q_train_model_store(spark, sf_dir):
    """Train on history and store; asked again for an initial
    model, the stored one is loaded and not fitted anew."""
    e = td.events_feed(spark, sf_dir, with_key=True)
    path = scratch_path(spark, "model-store")
    forest.train_model(e, path, params=ForestParams(key_cols=("row_key",)))
    other = ForestParams(key_cols=("row_key",), seed=1)
    forest.train_initial_model(e, path, other)
    return forest.detect_anomalies_streaming(e, path).select(
        "row_key", "is_anomaly", "anomaly_severity")


# The training job hashes whole rows: the text of the key and the amount.
# Whole amounts have the same text in any engine.
_JOB_CTES = FOREST_CTES.replace(
    O.events_sql(True), f"""SELECT row_key,
  CAST(floor(amount) AS BIGINT)::DOUBLE AS amount
  FROM ({O.events_sql(True)}) WHERE amount IS NOT NULL""").replace(
    "md5(CAST(row_key AS VARCHAR) ||", "md5(CAST(row_key AS VARCHAR) || '|' "
    "|| CAST(CAST(amount AS BIGINT) AS VARCHAR) || '.0' ||")


@register("train_job", f"""WITH RECURSIVE {_JOB_CTES}
SELECT row_key, is_anomaly, anomaly_severity FROM flags""",
          ("anomaly_severity",))
def q_train_job(spark, sf_dir):
    """A10: the command-line job trains on a CSV; its model flags the
    events."""
    from ..jobs import train
    e = td.events_feed(spark, sf_dir, with_key=True).where(
        F.col("amount").isNotNull()).withColumn(
        "amount", F.floor("amount").cast("double"))
    raw, path = scratch_path(spark, "history"), scratch_path(spark, "model")
    e.select("row_key", F.col("amount").cast("long").alias(
        "purchase_amount")).write.option("header", "true").csv(raw)
    if train.main(["--input", raw, "--output", path], spark):
        raise RuntimeError("the training job failed")
    return forest.detect_anomalies_streaming(e, path).select(
        "row_key", "is_anomaly", "anomaly_severity")


@register("persisted_reports", FOREST_SCORED + """
SELECT 'band' AS report, CASE WHEN trust_score >= 80 THEN 'High Trust'
    WHEN trust_score >= 50 THEN 'Moderate Trust' ELSE 'Critical Risk' END
    AS item, COUNT(*) AS records FROM t GROUP BY ALL
UNION ALL SELECT 'source', source_id, COUNT(*) FROM t GROUP BY ALL
UNION ALL SELECT 'flagged', source_id, COUNT(*) FROM t WHERE is_anomaly
GROUP BY ALL""")
def q_persisted_reports(spark, sf_dir):
    """One kept frame under several reports."""
    scored = reports.persist_scored(forest_scored(spark, sf_dir))
    source = F.col("source_id").alias("item")
    parts = [
        reports.trust_bands(scored).select(
            F.lit("band").alias("report"), F.col("trust_band").alias("item"),
            "records"),
        scored.groupBy(source).agg(F.count("*").alias("records")).select(
            F.lit("source").alias("report"), "item", "records"),
        scored.where("is_anomaly").groupBy(source).agg(
            F.count("*").alias("records")).select(
                F.lit("flagged").alias("report"), "item", "records")]
    try:
        return materialize(parts[0].union(parts[1]).union(parts[2]))
    finally:
        scored.unpersist()


# ------------------------------------------------- exact closed form
EXACT_SAMPLE = 256


def _exact_sample(spark, sf_dir):
    """Amounts of the 256 rows with the smallest md5 key hashes, sorted
    (the sample size is the operator's parameter)."""
    e = td.events_feed(spark, sf_dir, with_key=True).where(
        F.col("amount").isNotNull())
    rows = (e.withColumn("h", key_hash(["row_key"], 42, "md5"))
            .orderBy("h", "row_key").limit(EXACT_SAMPLE)
            .select("amount").collect())   # bounded: 256 values
    return sorted({r["amount"] for r in rows})


_EXACT_SQL = f"""WITH e AS ({O.events_sql(True)}),
s AS (SELECT DISTINCT amount AS a FROM (SELECT amount FROM e WHERE amount IS NOT NULL
      ORDER BY {_MD5_SQL}, row_key LIMIT {EXACT_SAMPLE})),
p AS (SELECT a, lead(a) OVER (ORDER BY a) AS nxt FROM s),
g AS (SELECT a AS lo, nxt AS hi, nxt - a AS gap FROM p WHERE nxt IS NOT NULL),
ends AS (SELECT min(a) AS amin, max(a) AS amax, count(*) AS n FROM s),
xs AS (SELECT DISTINCT amount AS x FROM e WHERE amount IS NOT NULL
       UNION SELECT 0.0::DOUBLE),
xc AS (SELECT x, LEAST(GREATEST(x, amin), amax) AS c FROM xs, ends),
ins AS (SELECT xc.x, SUM(CASE WHEN g.lo >= xc.c THEN g.gap / (g.hi - xc.c)
                              ELSE g.gap / (xc.c - g.lo) END) AS depth
        FROM xc JOIN s ON s.a = xc.c, g GROUP BY xc.x),
inside AS (SELECT xc.x, xc.c, k.lo AS ak, k.hi AS ak1 FROM xc JOIN g AS k
           ON k.lo < xc.c AND xc.c < k.hi),
gapd AS (SELECT i.x, 1.0 + SUM(CASE
    WHEN g.lo >= i.ak1 THEN g.gap / ((i.c - i.ak) + (i.ak1 - i.c) + (g.lo - i.ak1) + g.gap)
         * (1.0 + (i.c - i.ak) / ((g.lo - i.ak1) + g.gap))
    WHEN g.hi <= i.ak THEN g.gap / ((i.c - i.ak) + (i.ak1 - i.c) + (i.ak - g.hi) + g.gap)
         * (1.0 + (i.ak1 - i.c) / ((i.ak - g.hi) + g.gap))
    ELSE 0.0 END) AS depth FROM inside AS i, g GROUP BY i.x),
d AS (SELECT * FROM ins UNION ALL SELECT * FROM gapd),
cn AS (SELECT 2.0 * (ln(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n AS c FROM ends),
sc AS (SELECT d.x, d.depth, pow(2.0, -d.depth / cn.c) AS score FROM d, cn)"""


@register("isolation_depth_exact", _EXACT_SQL + """
SELECT x AS amount, depth, score FROM sc WHERE x IN (SELECT x FROM xs)""",
          ("amount", "depth", "score"))
def q_isolation_depth_exact(spark, sf_dir):
    """Expected isolation depth and score of every distinct amount (and of
    0.0, the scoring fill) under infinitely many unbounded trees."""
    sample = _exact_sample(spark, sf_dir)
    e = td.events_feed(spark, sf_dir)
    xs = (e.where(F.col("amount").isNotNull()).select(F.col("amount").alias("x"))
          .union(spark.range(1).select(F.lit(0.0).alias("x"))).distinct())
    out = forest.exact_isolation_scores(xs, sample)
    return out.select(F.col("x").alias("amount"), "depth", "score")


@register("isolation_flags_exact", _EXACT_SQL + """,
thr AS (SELECT quantile_cont(sc.score, 0.95) AS t FROM sc JOIN s ON sc.x = s.a)
SELECT e.row_key, sc.score > thr.t AS is_anomaly,
  sc.score - thr.t AS anomaly_severity
FROM e JOIN sc ON sc.x = COALESCE(e.amount, 0.0::DOUBLE), thr""",
          ("anomaly_severity",))
def q_isolation_flags_exact(spark, sf_dir):
    """Flags from the closed form: threshold = 95 % quantile of the sample
    points' scores; a null amount is scored as 0.0."""
    sample = np.array(_exact_sample(spark, sf_dir))
    thr = float(np.quantile(forest.exact_scores(sample, sample), 0.95))
    e = td.events_feed(spark, sf_dir, with_key=True).withColumn(
        "x", F.coalesce(F.col("amount"), F.lit(0.0)))
    # the score is a function of the amount: no distinct, no join
    out = forest.exact_isolation_scores(e, sample)
    return out.select("row_key", (F.col("score") > F.lit(thr)).alias("is_anomaly"),
                      (F.col("score") - F.lit(thr)).alias("anomaly_severity"))
