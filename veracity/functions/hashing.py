"""Deterministic per-row hashes for sampling and tie-breaking.

``sample(fraction, seed)`` depends on how rows are split into partitions,
so it gives another sample after a repartition or on another cluster.
A hash of the row's key is the same wherever the row lands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = float(2 ** 32)


def key_hash(key_cols: Sequence[str], seed: int = 42,
             method: str = "xxhash64") -> Column:
    """An unsigned 32-bit hash of the key columns (as LONG, 0..2^32-1).

    ``xxhash64`` is the fast JVM built-in.  ``md5`` hashes the text of the
    key, the first 8 hex digits read as a number; it is slower but has the
    same value in any SQL engine with md5, which the oracle checks use.
    """
    cols = [F.col(c) for c in key_cols]
    if method == "md5":
        text = F.concat_ws("|", *[c.cast("string") for c in cols])
        if seed:
            text = F.concat(text, F.lit(f"#{seed}"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(2 ** 32))


def unit_hash(key_cols: Sequence[str], seed: int = 42,
              method: str = "xxhash64") -> Column:
    """The key hash scaled to [0, 1)."""
    return key_hash(key_cols, seed, method) / F.lit(_UNIT)
