"""Lenient parsing of dirty text fields (ANSI stays on; nothing throws)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the message timestamp pattern of the stream schema ---
ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss"
# --- end of fixed values ---


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(c: str | Column, patterns=(ISO_PATTERN,),
                    lenient: bool = True) -> Column:
    """First pattern that parses wins; unparsable text becomes null.

    ``lenient`` adds Spark's own parser as the last resort, which takes
    fractions of a second, a space separator, a bare date and a zone
    suffix.  Values that already are timestamps are cast, not parsed.
    """
    s = _c(c).cast("string")
    tries = [F.try_to_timestamp(s, F.lit(p)) for p in patterns]
    if lenient:
        tries.append(F.try_to_timestamp(F.trim(s)))
    return tries[0] if len(tries) == 1 else F.coalesce(*tries)
