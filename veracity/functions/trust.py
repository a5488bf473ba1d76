"""Column expressions for decay, trust and the report bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import (ALERT_RATE, HIGH_SEVERITY, LOWEST_BAND, TRUST_BANDS)
from .quality import as_of_column, day_diff


def temporal_decay(age_from: str | Column, as_of, rate: float) -> Column:
    """exp(-rate * whole days between ``age_from`` and ``as_of``).

    A negative age (ingested after ``as_of``) gives a factor above 1; no
    clamp, as in the reference.
    """
    days = day_diff(as_of_column(as_of), age_from)
    return F.exp(F.lit(-float(rate)) * days)


def trust_score(quality: Column, reputation: Column, decay: Column,
                default_reputation: float | None = None,
                clamp: bool = False) -> Column:
    """quality * reputation * decay * 100; nulls propagate."""
    rep = reputation if default_reputation is None else F.coalesce(
        reputation, F.lit(float(default_reputation)))
    score = quality * rep * decay * F.lit(100.0)
    if clamp:
        score = F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))
    return score


def trust_band(score: str | Column) -> Column:
    """High / Moderate / Critical band of a 0-100 trust score."""
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for bound, label in TRUST_BANDS:
        expr = (F.when(s >= bound, label) if expr is None
                else expr.when(s >= bound, label))
    return expr.otherwise(LOWEST_BAND)


def severity_level(severity: str | Column,
                   high: float = HIGH_SEVERITY) -> Column:
    s = F.col(severity) if isinstance(severity, str) else severity
    return F.when(s > F.lit(float(high)), "high").otherwise("medium")


def rate_alert(rate: Column, limit: float = ALERT_RATE) -> Column:
    return rate > F.lit(float(limit))


__all__ = ["temporal_decay", "trust_score", "trust_band", "severity_level",
           "rate_alert", "as_of_column"]
