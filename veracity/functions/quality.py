"""Column expressions for the five quality dimensions.

Each function returns a Spark ``Column``; nothing here touches data.  All
of them are JVM-side built-ins, so a stage that applies them stays inside
one whole-stage-codegen span and works unchanged on streaming frames.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DERIVED_COLUMNS


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_column(as_of=None) -> Column:
    """A literal timestamp, a Column, or ``current_timestamp()``."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def day_diff(end: str | Column, start: str | Column) -> Column:
    """Calendar-day difference (midnights crossed), as ``datediff``."""
    return F.datediff(_c(end), _c(start))


def completeness_fields(columns: Iterable[str]) -> list[str]:
    """Fields counted by dynamic completeness: all but the derived ones."""
    return [c for c in columns if c not in DERIVED_COLUMNS]


def completeness(fields: Iterable[str], available=None) -> Column:
    """Share of non-null fields; NaN and empty strings count as present.

    With ``available`` (the frame's columns), a listed field the frame
    lacks counts as missing instead of failing the analysis."""
    fields = list(fields)
    present = [F.when(F.col(c).isNull(), 0.0).otherwise(1.0)
               if available is None or c in available else F.lit(0.0)
               for c in fields]
    total = F.lit(0.0)
    for p in present:
        total = total + p
    return (total / F.lit(float(max(1, len(fields))))).cast("double")


def consistency(amount: str | Column) -> Column:
    """1 when the amount is present (NaN is present), else 0."""
    return F.when(_c(amount).isNull(), 0.0).otherwise(1.0)


def accuracy(amount: str | Column, max_amount: float) -> Column:
    """1 when 0 <= amount <= max_amount; null and NaN give 0."""
    a = _c(amount)
    return (F.when(a.isNull(), 0.0)
            .when((a >= F.lit(0.0)) & (a <= F.lit(float(max_amount))), 1.0)
            .otherwise(0.0))


def freshness(ts: str | Column, as_of, freshness_days: int) -> Column:
    """Linear decay over ``freshness_days`` calendar days; future is 1."""
    t = _c(ts)
    days = day_diff(as_of_column(as_of), t)
    return (F.when(t.isNull(), 0.0)
            .when(days <= 0, 1.0)
            .when(days >= freshness_days, 0.0)
            .otherwise(1.0 - days / F.lit(float(freshness_days))))


def timeliness(ts: str | Column, ingestion: str | Column,
               grace_days: int, horizon_days: int) -> Column:
    """1 within the grace period, 0 past the horizon, linear between."""
    t = _c(ts)
    delay = day_diff(ingestion, t)
    span = float(horizon_days - grace_days)
    return (F.when(t.isNull(), 0.0)
            .when(delay <= grace_days, 1.0)
            .when(delay >= horizon_days, 0.0)
            .otherwise(1.0 - (delay - F.lit(grace_days)) / F.lit(span)))


def quality_score(cols=("completeness", "consistency", "accuracy",
                        "freshness", "timeliness")) -> Column:
    """Mean of the five dimensions; a null dimension makes it null."""
    total = None
    for c in cols:
        total = F.col(c) if total is None else total + F.col(c)
    return total / F.lit(float(len(cols)))
