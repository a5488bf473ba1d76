"""Parameter objects, one per stage.

The batch and streaming variants of an operator are the same code with
other constants; the constants live here, together.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --- fixed values (must equal the reference's to reproduce its scores) ---
# Columns left out of dynamic completeness (derived columns):
DERIVED_COLUMNS = (
    "ingestion_timestamp", "completeness", "consistency", "accuracy",
    "freshness", "timeliness", "is_anomaly", "anomaly_severity",
)
# Fields counted by the fixed (streaming) completeness:
STREAM_FIELDS = ("user_id", "purchase_amount", "city", "timestamp", "source_id")
# Batch: amount bound 100000, freshness 365 days, grace 7 days, horizon 365.
# Streaming: amount bound 10000, freshness 30 days, grace 7 days, horizon 45.
# Decay 0.05 per day; streaming default reputation 0.5.
# Trust bands: >= 80 "High Trust", >= 50 "Moderate Trust", else "Critical Risk".
TRUST_BANDS = ((80.0, "High Trust"), (50.0, "Moderate Trust"))
LOWEST_BAND = "Critical Risk"
# Alert rules: anomaly rate above 5 %; severity above 0.8 is "high".
ALERT_RATE = 0.05
HIGH_SEVERITY = 0.8
# Forest: 100 trees, 256 samples per tree, contamination 0.05, seed 42.
# --- end of fixed values ---

UNIFIED_COLUMNS = ("user_id", "amount", "city", "timestamp", "source_id")


@dataclass(frozen=True)
class QualityParams:
    """Constants of the five quality dimensions."""

    amount_col: str = "amount"
    timestamp_col: str = "timestamp"
    ingestion_col: str = "ingestion_timestamp"
    # None: dynamic completeness over every non-derived column.
    completeness_fields: tuple[str, ...] | None = None
    max_amount: float = 100_000.0
    freshness_days: int = 365
    grace_days: int = 7
    horizon_days: int = 365

    @classmethod
    def batch(cls, **kw) -> "QualityParams":
        return replace(cls(), **kw)

    @classmethod
    def streaming(cls, **kw) -> "QualityParams":
        base = cls(amount_col="purchase_amount",
                   completeness_fields=STREAM_FIELDS,
                   max_amount=10_000.0, freshness_days=30,
                   grace_days=7, horizon_days=45)
        return replace(base, **kw)


@dataclass(frozen=True)
class TrustParams:
    """Constants of decay and trust."""

    decay_rate: float = 0.05
    # None keeps a null reputation null (batch); 0.5 is the stream default.
    default_reputation: float | None = None
    # Column the decay age is measured from (ingestion time by default,
    # the record time for the documented age-decay variant).
    age_col: str = "ingestion_timestamp"
    clamp: bool = False

    @classmethod
    def batch(cls, **kw) -> "TrustParams":
        return replace(cls(), **kw)

    @classmethod
    def streaming(cls, **kw) -> "TrustParams":
        return replace(cls(default_reputation=0.5), **kw)

    @classmethod
    def age_decay(cls, **kw) -> "TrustParams":
        """The documented alternative: exp(-0.1 * record age in days)."""
        return replace(cls(decay_rate=0.1, age_col="timestamp"), **kw)


@dataclass(frozen=True)
class ForestParams:
    """Isolation forest settings."""

    n_trees: int = 100
    max_samples: int = 256
    contamination: float = 0.05
    seed: int = 42
    sample_fraction: float = 0.1
    feature_col: str = "amount"
    # Training imputes the sample median, scoring imputes this constant.
    score_fill: float = 0.0
    key_cols: tuple[str, ...] | None = None
