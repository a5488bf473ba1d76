"""The driver's test tables seen as the reference's feeds.

``events`` is the main feed (event_type = source, value = amount, the
``k`` key of ``props`` = city, ts = timestamp); ``orders``, ``lineitem``
and ``customer`` are three more feeds.  The tables hold no nulls, so
nulls are injected by key, the same way in Spark here and in the SQL
oracle (``plans.oracle``).  Nothing is filtered out: every row of every
table is read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.unify import map_feed
from ..sources.feeds import FeedMapping

# --- fixed values of the harness ---
EVENTS_AS_OF = "2024-02-01 00:00:00"
TPCH_AS_OF = "2001-12-01 00:00:00"
# Null injection: key % m = 0 nulls the field.
NULL_AMOUNT, NULL_TIMESTAMP, NULL_CITY, NULL_USER = 13, 17, 7, 11
# The "given flag" used where results are compared with SQL: amounts
# above this bound are flagged, severity = amount / bound - 1 (a null
# amount is scored as 0.0, as the forest's scoring imputes).
GIVEN_FLAG_BOUND = 150.0
# --- end of fixed values ---


@dataclass(frozen=True)
class HarnessFeed:
    """A driver table as a raw feed: its key and the mapped columns."""

    table: str
    key: str                 # SQL expression of a unique row key
    user_id: str
    amount: str
    city: str | None
    timestamp: str | None
    tag: str | None          # constant source tag; None: a column
    source_col: str | None = None
    city_expr: str | None = None   # derived city column (Spark SQL)
    city_sql: str | None = None    # the same in DuckDB
    amount_expr: str | None = None  # amount replaced by it (any SQL)
    ts_expr: str | None = None     # derived timestamp column (Spark SQL)
    ts_sql: str | None = None      # the same in DuckDB


EVENTS = HarnessFeed("events", "event_id", "user_id", "value", "city", "ts",
                     None, source_col="event_type",
                     city_expr="get_json_object(props, '$.k')",
                     city_sql="json_extract_string(props, '$.k')",
                     # past accuracy's upper bounds, and below zero
                     amount_expr="CASE WHEN event_id % 29 = 0 THEN value * 1000 "
                     "WHEN event_id % 31 = 0 THEN -value ELSE value END")
ORDERS = HarnessFeed("orders", "o_orderkey", "o_custkey", "o_totalprice",
                     "o_orderpriority", "o_orderdate", "orders")
LINEITEM = HarnessFeed("lineitem", "l_orderkey * 10 + l_linenumber",
                       "l_suppkey", "l_extendedprice", "l_returnflag",
                       "l_shipdate", "lineitem")
CUSTOMER = HarnessFeed("customer", "c_custkey", "c_custkey", "c_acctbal",
                       "c_mktsegment", None, "customer")
# the customers as a feed: with a timestamp, so that they count
CUSTOMER_FEED = replace(
    CUSTOMER, timestamp="c_since",
    ts_expr="timestamp'2024-01-01 00:00:00' "
    "+ make_dt_interval(cast(c_custkey % 30 as int))",
    ts_sql="TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 30 AS INTEGER))")
FEEDS = {f.table: f for f in (EVENTS, ORDERS, LINEITEM, CUSTOMER_FEED)}
FOUR = ("orders", "lineitem", "events", "customer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null_if(key: Column, m: int, value: Column) -> Column:
    return F.when(key % m == 0, F.lit(None)).otherwise(value)


def dirty_table(spark: SparkSession, sf_dir: str, feed: HarnessFeed,
                with_key: bool = False) -> DataFrame:
    """The raw table, mapped columns nulled by key, original names kept."""
    return dirty_frame(table(spark, sf_dir, feed.table), feed, with_key)


def dirty_frame(df: DataFrame, feed: HarnessFeed, with_key: bool = False
                ) -> DataFrame:
    """``dirty_table`` on a given (possibly streaming) frame."""
    k = F.expr(feed.key)
    if feed.city_expr:
        df = df.withColumn(feed.city, F.expr(feed.city_expr))
    if feed.amount_expr:
        df = df.withColumn(feed.amount, F.expr(feed.amount_expr))
    if feed.ts_expr:
        df = df.withColumn(feed.timestamp, F.expr(feed.ts_expr))
    rules = {feed.user_id: NULL_USER, feed.amount: NULL_AMOUNT}
    if feed.city:
        rules[feed.city] = NULL_CITY
    if feed.timestamp:
        rules[feed.timestamp] = NULL_TIMESTAMP
    cols = {c: _null_if(k, m, F.col(c)) for c, m in rules.items()}
    if with_key:
        cols["row_key"] = k.cast("long")
    return df.withColumns(cols)


def mapping(feed: HarnessFeed, tag: str | None = None, **kw) -> FeedMapping:
    cols = {"user_id": feed.user_id, "amount": feed.amount}
    if feed.city:
        cols["city"] = feed.city
    if feed.timestamp:
        cols["timestamp"] = feed.timestamp
    consts = {}
    if tag or feed.tag:
        consts["source_id"] = tag or feed.tag
    else:
        cols["source_id"] = feed.source_col
    cols.update(kw.pop("columns", {}))
    consts.update(kw.pop("constants", {}))
    return FeedMapping(feed.table, columns=cols, constants=consts, **kw)


def raw_feed(spark: SparkSession, sf_dir: str, feed: HarnessFeed,
             tag: str | None = None, with_key: bool = False) -> DataFrame:
    """The feed as the five unified columns (plus ``row_key`` if asked)."""
    dirty = dirty_table(spark, sf_dir, feed, with_key)
    return map_feed(dirty, mapping(feed, tag),
                    keep=("row_key",) if with_key else ())


def events_feed(spark: SparkSession, sf_dir: str, as_of: str = EVENTS_AS_OF,
                with_key: bool = False) -> DataFrame:
    """Events as unified records, ingested at ``as_of``."""
    return raw_feed(spark, sf_dir, EVENTS, with_key=with_key).withColumn(
        "ingestion_timestamp", F.lit(as_of).cast("timestamp"))


def four_feeds(spark: SparkSession, sf_dir: str, with_key: bool = False
               ) -> list[DataFrame]:
    """orders, lineitem, events, customer, each tagged with its name."""
    return [raw_feed(spark, sf_dir, FEEDS[n], tag=n, with_key=with_key)
            for n in FOUR]


def given_flags(df: DataFrame, bound: float = GIVEN_FLAG_BOUND) -> DataFrame:
    """A fixed, SQL-reproducible outlier flag for oracle-checked queries."""
    a = F.coalesce(F.col("amount"), F.lit(0.0))
    return df.withColumns({"is_anomaly": a > F.lit(bound),
                           "anomaly_severity": a / F.lit(bound) - 1.0})
