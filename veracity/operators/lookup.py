"""Joining a per-key table back onto the records.

Several operators are two-pass: aggregate per key, then give every record
its key's value.  The aggregate is materialised once (``checkpoint`` into
the shared checkpoint folder, so a lost executor does not recompute the
upstream), its size in bytes is checked, and only a table under the bound
is broadcast.  Anything bigger is joined with a shuffle, where AQE can split
skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

DEFAULT_BROADCAST_BYTES = 64 << 20


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_bytes(df: DataFrame) -> int:
    """Bytes of a frame's rows: 8 per fixed-width field and the length of
    the texts, plus 16 per row; one aggregate."""
    texts = [c for c, t in df.dtypes if t in ("string", "binary")]
    fixed = 16 + 8 * len(df.columns)
    length = F.lit(0)
    for c in texts:
        length = length + F.coalesce(F.octet_length(c), F.lit(0))
    r = df.agg(F.count(F.lit(1)), F.sum(length)).first()
    return r[0] * fixed + (r[1] or 0)


def lookup_join(records: DataFrame, lookup: DataFrame, keys: Sequence[str],
                how: str = "left", null_safe: bool = False,
                max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES
                ) -> DataFrame:
    """Join ``lookup`` (one row per key) onto ``records``.

    ``null_safe`` matches null keys to null keys (``<=>``), which the
    window-style operators need; the plain form lets a null key match
    nothing.
    """
    keys = list(keys)
    small = materialize(lookup)
    fits = table_bytes(small) <= max_broadcast_bytes
    if not null_safe:
        return records.join(F.broadcast(small) if fits else small,
                            on=keys, how=how)
    renamed = {k: f"__lk_{i}" for i, k in enumerate(keys)}
    small = small.withColumnsRenamed(renamed)
    if fits:
        small = F.broadcast(small)
    cond = None
    for k, r in renamed.items():
        c = records[k].eqNullSafe(small[r])
        cond = c if cond is None else cond & c
    return records.join(small, on=cond, how=how).drop(*renamed.values())
