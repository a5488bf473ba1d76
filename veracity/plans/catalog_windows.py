"""Time-windowed reputation queries (R2, R3, ST5, EMA) with oracles."""

from __future__ import annotations

from ..operators import reputation
from . import oracle as O
from . import testdata as td
from .catalog import register

_FLAGGED = f"""f AS ({O.events_sql(True)}),
q AS (SELECT *, {O.flags_sql()} FROM f)"""
_A = "CASE WHEN is_anomaly THEN 1 ELSE 0 END"


def flagged_events(spark, sf_dir):
    return td.given_flags(td.events_feed(spark, sf_dir, with_key=True))


def _rolling_sql(seconds: int) -> str:
    return f"""WITH {_FLAGGED},
k AS (SELECT *, CAST(floor(epoch("timestamp")) AS BIGINT) AS sec FROM q),
w AS (SELECT row_key, source_id,
  CAST(SUM({_A}) OVER win AS BIGINT) AS a, COUNT(*) OVER win AS n FROM k
  WINDOW win AS (PARTITION BY source_id ORDER BY sec
                 RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW))"""


ROLLING_SQL = _rolling_sql(3600) + """
SELECT row_key, source_id, a AS anomalies_in_window, n AS total_in_window,
  CASE WHEN n > 0 THEN 1.0::DOUBLE - a::DOUBLE / n ELSE 0.5::DOUBLE END
    AS source_reputation FROM w"""
_COLS = ("row_key", "source_id", "anomalies_in_window", "total_in_window",
         "source_reputation")


@register("rolling_reputation", ROLLING_SQL, ("source_reputation",))
def q_rolling_reputation(spark, sf_dir):
    """R2: per-second reduction, windows per source and day, join."""
    out = reputation.compute_source_reputation_streaming(
        flagged_events(spark, sf_dir), "1 hour")
    return out.select(*_COLS)


@register("rolling_reputation_bucketed", ROLLING_SQL, ("source_reputation",))
def q_rolling_reputation_bucketed(spark, sf_dir):
    """R2 with time chunks shorter than the window."""
    out = reputation.compute_source_reputation_streaming(
        flagged_events(spark, sf_dir), "1 hour", chunk_seconds=1_500)
    return out.select(*_COLS)


@register("recent_reputation", _rolling_sql(600) + """
SELECT row_key, source_id, a::DOUBLE / n AS recent_anomaly_rate,
  1.0::DOUBLE - a::DOUBLE / n AS source_reputation FROM w""",
          ("recent_anomaly_rate", "source_reputation"))
def q_recent_reputation(spark, sf_dir):
    """R3 as coded: 1 - anomaly rate of the trailing 600 s."""
    out = reputation.compute_source_reputation_recent(
        flagged_events(spark, sf_dir), 600)
    return out.select("row_key", "source_id", "recent_anomaly_rate",
                      "source_reputation")


SLIDING_SQL = f"""WITH {_FLAGGED},
k AS (SELECT *, CAST(floor(epoch("timestamp") / 600) AS BIGINT) AS b FROM q),
pb AS (SELECT source_id, b, SUM({_A}) AS a, COUNT(*) AS n FROM k
       WHERE b IS NOT NULL GROUP BY source_id, b),
w AS (SELECT source_id, b, SUM(a) OVER win AS wa, SUM(n) OVER win AS wn FROM pb
      WINDOW win AS (PARTITION BY source_id ORDER BY b
                     RANGE BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT k.row_key, k.source_id,
  make_timestamp((w.b - 5) * 600 * 1000000) AS window_start,
  make_timestamp((w.b + 1) * 600 * 1000000) AS window_end,
  CAST(w.wa AS BIGINT) AS anomalies_in_window,
  CAST(w.wn AS BIGINT) AS total_in_window,
  1.0::DOUBLE - w.wa::DOUBLE / w.wn AS source_reputation
FROM k LEFT JOIN w ON k.source_id = w.source_id AND k.b = w.b"""


@register("sliding_reputation", SLIDING_SQL, ("source_reputation",))
def q_sliding_reputation(spark, sf_dir):
    """ST5 on a bounded frame: 1 h windows every 10 min, each record
    joined to the window closing at the end of its 10-minute bucket."""
    out = reputation.compute_sliding_reputation(
        flagged_events(spark, sf_dir), "1 hour", "10 minutes")
    return out.select("row_key", "source_id", "window_start", "window_end",
                      "anomalies_in_window", "total_in_window",
                      "source_reputation")


EMA_SQL = f"""WITH RECURSIVE {_FLAGGED},
k AS (SELECT *, CAST(floor(epoch("timestamp") / 600) AS BIGINT) AS b FROM q),
pb AS (SELECT source_id, b, SUM({_A})::DOUBLE / COUNT(*) AS rate FROM k
       WHERE b IS NOT NULL GROUP BY source_id, b),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY b) AS i
      FROM pb),
e(source_id, i, b, ema) AS (
  SELECT source_id, i, b, rate FROM o WHERE i = 1
  UNION ALL
  SELECT o.source_id, o.i, o.b, 0.7::DOUBLE * e.ema + 0.3::DOUBLE * o.rate
  FROM e JOIN o ON o.source_id = e.source_id AND o.i = e.i + 1)
SELECT k.row_key, k.source_id, e.ema AS ema_anomaly_rate,
  1.0::DOUBLE - e.ema AS source_reputation
FROM k LEFT JOIN e ON k.source_id = e.source_id AND k.b = e.b"""


@register("ema_reputation", EMA_SQL, ("ema_anomaly_rate",
                                      "source_reputation"))
def q_ema_reputation(spark, sf_dir):
    """R3 as documented: alpha-smoothed anomaly rate of 10-minute buckets."""
    out = reputation.compute_source_reputation_exponential_moving_average(
        flagged_events(spark, sf_dir), alpha=0.3,
        bucket_duration="10 minutes")
    return out.select("row_key", "source_id", "ema_anomaly_rate",
                      "source_reputation")

