"""Independent SQL (DuckDB dialect) for the oracle checks.

Written from the operator definitions, not generated from the Spark
plans.  Doubles are rounded to 6 places on both sides before comparison.
"""

from __future__ import annotations

from . import testdata as td

D = "DOUBLE"
# The published constants, written out here on purpose: the engine takes
# its own from ``params``, so a wrong one there shows as a mismatch.
CONSTANTS = {
    "batch": {"amount": "amount", "max": 100000, "fresh": 365, "grace": 7,
              "horizon": 365},
    "stream": {"amount": "purchase_amount", "max": 10000, "fresh": 30,
               "grace": 7, "horizon": 45},
}
FIELDS = {
    "batch": ("user_id", "amount", "city", "timestamp", "source_id"),
    "stream": ("user_id", "purchase_amount", "city", "timestamp",
               "source_id"),
}


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def ts_lit(t: str) -> str:
    return f"TIMESTAMP '{t}'"


def _null_if(key: str, m: int, value: str) -> str:
    return f"CASE WHEN ({key}) % {m} = 0 THEN NULL ELSE {value} END"


def feed_sql(feed: td.HarnessFeed, tag: str | None = None,
             with_key: bool = False, ingestion: str | None = None) -> str:
    """SELECT of the five unified columns of a harness feed."""
    k = feed.key
    city = feed.city_sql or feed.city
    cols = []
    if with_key:
        cols.append(f"CAST({k} AS BIGINT) AS row_key")
    cols.append(f"{_null_if(k, td.NULL_USER, f'CAST({feed.user_id} AS VARCHAR)')} AS user_id")
    cols.append(f"{_null_if(k, td.NULL_AMOUNT, dbl(feed.amount_expr or feed.amount))} AS amount")
    cols.append((f"{_null_if(k, td.NULL_CITY, f'CAST({city} AS VARCHAR)')}"
                 if feed.city else "CAST(NULL AS VARCHAR)") + " AS city")
    cols.append((f"{_null_if(k, td.NULL_TIMESTAMP, f'CAST({feed.ts_sql or feed.timestamp} AS TIMESTAMP)')}"
                 if feed.timestamp else "CAST(NULL AS TIMESTAMP)")
                + ' AS "timestamp"')
    src = f"'{tag or feed.tag}'" if (tag or feed.tag) else feed.source_col
    cols.append(f"{src} AS source_id")
    if ingestion:
        cols.append(f"{ingestion} AS ingestion_timestamp")
    return f"SELECT {', '.join(cols)} FROM {feed.table}"


def events_sql(with_key: bool = False, as_of: str = td.EVENTS_AS_OF) -> str:
    return feed_sql(td.EVENTS, with_key=with_key, ingestion=ts_lit(as_of))


def flags_sql(bound: float = td.GIVEN_FLAG_BOUND) -> str:
    a = "COALESCE(amount, 0.0::DOUBLE)"
    return (f"{a} > {dbl(bound)} AS is_anomaly, "
            f"{a} / {dbl(bound)} - 1.0::DOUBLE AS anomaly_severity")


def quality_sql(kind: str, as_of: str,
                ingestion: str = "ingestion_timestamp") -> str:
    """The five dimension columns, as SQL select items."""
    k, fields = CONSTANTS[kind], FIELDS[kind]
    amt, ts = k["amount"], '"timestamp"'
    comp = " + ".join(f'(CASE WHEN "{c}" IS NULL THEN 0.0 ELSE 1.0 END)'
                      for c in fields)
    d = f"datediff('day', {ts}, {ts_lit(as_of)})"
    delay = f"datediff('day', {ts}, {ingestion})"
    span = k["horizon"] - k["grace"]
    return ", ".join([
        f"{dbl(f'({comp}) / {max(1, len(fields))}')} AS completeness",
        f"CASE WHEN {amt} IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS consistency",
        (f"CASE WHEN {amt} IS NULL THEN 0.0 WHEN {amt} >= 0 AND {amt} <= "
         f"{dbl(k['max'])} THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy"),
        (f"CASE WHEN {ts} IS NULL THEN 0.0::DOUBLE WHEN {d} <= 0 THEN 1.0::DOUBLE "
         f"WHEN {d} >= {k['fresh']} THEN 0.0::DOUBLE "
         f"ELSE 1.0::DOUBLE - {d} / {dbl(k['fresh'])} END AS freshness"),
        (f"CASE WHEN {ts} IS NULL THEN 0.0::DOUBLE WHEN {delay} <= {k['grace']} "
         f"THEN 1.0::DOUBLE WHEN {delay} >= {k['horizon']} THEN 0.0::DOUBLE "
         f"ELSE 1.0::DOUBLE - ({delay} - {k['grace']}) / {dbl(span)} END "
         f"AS timeliness"),
    ])


QSUM = "(completeness + consistency + accuracy + freshness + timeliness)"


def scored_events_sql(as_of: str = td.EVENTS_AS_OF, with_key: bool = True,
                      default_rep: float | None = None,
                      flags: str | None = None) -> str:
    """CTE text: events, quality, flag (the given one, or those of a table
    ``flags`` by row_key), reputation, decay, trust."""
    flag_cols = flags_sql() if flags is None else (
        f"{flags}.is_anomaly, {flags}.anomaly_severity")
    joined = "f" if flags is None else f"f JOIN {flags} USING (row_key)"
    rep = "r.source_reputation"
    if default_rep is not None:
        rep = f"COALESCE(r.source_reputation, {dbl(default_rep)})"
    return f"""
f AS ({events_sql(with_key, as_of)}),
q AS (SELECT f.*, {quality_sql("batch", as_of)}, {flag_cols} FROM {joined}),
r AS (SELECT source_id, 1.0::DOUBLE - SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END)::DOUBLE
             / COUNT(*) AS source_reputation FROM q GROUP BY source_id),
s AS (SELECT q.*, r.source_reputation,
             exp(-0.05::DOUBLE * datediff('day', q.ingestion_timestamp, {ts_lit(as_of)}))
               AS temporal_decay
      FROM q LEFT JOIN r ON q.source_id = r.source_id),
t AS (SELECT *, {QSUM} / 5.0::DOUBLE * {rep.replace('r.', '')}
                 * temporal_decay * 100.0::DOUBLE AS trust_score FROM s)"""


def round_doubles(sql: str, doubles) -> str:
    """Wrap a query so the listed double columns are rounded to 6 places."""
    if not doubles:
        return sql
    items = ", ".join(f"ROUND({c}, 6) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({items}) FROM ({sql}) AS oracle_q"
