"""Token counts of the sections of documents, encoded once as a whole.

Encoding each section on its own gives other tokens than the document
has, since tokens form across borders.  Here a document is encoded once;
the prefix sums of its tokens' byte lengths are their spans, and an
interval join (two sorted lists per document) attributes tokens to the
sections.  A token that crosses a border goes by an explicit rule:

* ``start``: to the section of its first byte;
* ``most``: to the section that holds most of its bytes, the first one of
  equals.
* ``share``: to each by the share of its bytes (fractional counts).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .chat import SPLIT

RULES = ("start", "most", "share")


@dataclass(frozen=True)
class TokenParams:
    """Sections end with ``separator``, which belongs to them."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    rule: str = "most"
    separator: str = "\n"


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("count", pat_str=SPLIT, mergeable_ranks=ranks,
                             special_tokens={}), size


def section_borders(data: bytes, separator: bytes) -> np.ndarray:
    """Byte borders of the sections; an empty text has no section."""
    ends, at = [0], data.find(separator)
    while at >= 0:
        ends.append(at + len(separator))
        at = data.find(separator, at + len(separator))
    if ends[-1] < len(data):
        ends.append(len(data))
    return np.array(ends, np.int64)


def attribute(ends: np.ndarray, borders: np.ndarray, rule: str
              ) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per section, crossing tokens per section that they start
    in).  ``ends``: where each token ends, in bytes; ``borders``: where
    the sections begin and the last one ends."""
    n = len(borders) - 1
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(borders, starts, "right") - 1
    last = np.searchsorted(borders, ends, "left") - 1
    crossing = np.bincount(first[last > first], minlength=n)
    if rule == "start" or not (last > first).any():
        return np.bincount(first, minlength=n).astype(float), crossing
    count = np.bincount(first[last == first], minlength=n).astype(float)
    for k in np.flatnonzero(last > first):
        s = np.arange(first[k], last[k] + 1)
        held = (np.minimum(borders[s + 1], ends[k])
                - np.maximum(borders[s], starts[k]))
        if rule == "most":
            count[s[int(held.argmax())]] += 1
        else:
            count[s] += held / (ends[k] - starts[k])
    return count, crossing


SCHEMA = ("doc_id long, n_tokens long, begins array<long>, "
          "tokens array<double>, crossing array<long>")


def _count(p: TokenParams):
    if p.rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sep = p.separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = _encoder(p.vocabulary)
        for batch in batches:
            out = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                ids = np.array(enc.encode_ordinary(text), np.int64)
                raw = text.encode()
                ends = np.cumsum(size[ids]) if len(ids) else ids
                if len(ids) and int(ends[-1]) != len(raw):
                    raise ValueError("the tokens don't cover the text")
                borders = section_borders(raw, sep)
                count, crossing = (attribute(ends, borders, p.rule)
                                   if len(ids) else ([], []))
                # borders in characters: bytes that begin one
                heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0)
                                       != 0x80)
                out[0].append(len(ids))
                out[1].append(np.searchsorted(heads, borders[:-1]))
                out[2].append(count)
                out[3].append(crossing)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()),
                 pa.array(out[1], pa.list_(pa.int64())),
                 pa.array(out[2], pa.list_(pa.float64())),
                 pa.array(out[3], pa.list_(pa.int64()))],
                names=[c.split()[0] for c in SCHEMA.split(", ")])
    return run


def token_counts(docs: DataFrame, params: TokenParams = TokenParams(),
                 id_col: str = "doc_id", text_col: str = "text"
                 ) -> DataFrame:
    """One row per document: doc_id, n_tokens and, per section, where it
    begins (characters), its tokens and how many tokens that start in it
    run past its end.

    A null or empty text has no tokens and no sections.  A document's
    section counts add up to its n_tokens.  Repeated rows and null ids are
    counted like any other row.
    """
    rows = C.own_columns(docs, {id_col: "doc_id", text_col: "text"}).select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with C.text_batches(docs.sparkSession):
        return C.save(rows.mapInArrow(_count(params), SCHEMA), "tokens")


def section_table(docs: DataFrame, params: TokenParams = TokenParams()
                  ) -> DataFrame:
    """One row per section: doc_id, section (from 0), begins, tokens,
    crossing, n_tokens (of the document).  A document without sections has
    one row with section null."""
    t = token_counts(docs, params)
    t = t.select("doc_id", "n_tokens", F.posexplode_outer(F.arrays_zip(
        "begins", "tokens", "crossing")).alias("section", "s"))
    return t.select("doc_id", "section", "s.begins", "s.tokens",
                    "s.crossing", "n_tokens")
