"""Best-fit packing of tokenized documents into training sequences.

A document is its token ids and an end id.  Only a document longer than a
sequence is cut, from its end, into whole sequences and a shorter first
piece.

Large-item matching: of pieces above a third of the capacity at most two
share a sequence, so they are matched greedily, the longest with the
longest that still fits.  Smaller pieces, the longest first, go into the
tightest gap that holds them.

Pieces of one length are interchangeable, so the plan needs nothing but
how many there are of each length: at most ``capacity`` counts reach the
driver, and the plan is a list of runs, "pieces number a to b of length n
go to sequences s, s + 1, ... at offset o".  Its size depends on the
capacity, not on the documents.  A piece's number among those of its
length is a two-level prefix sum, so the pieces of a common length are no
single window; its place is looked up in the runs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .chat import SPLIT

# A text is encoded in one call; ids of several texts are handed on at once.
_IDS_PER_BATCH = 1 << 20


@dataclass(frozen=True)
class PackParams:
    """``vocabulary``: a byte-level BPE in the tokenizers library's format;
    None takes the public one that lies where the package says."""

    capacity: int = 1024
    end_id: int = 2
    vocabulary: str | None = None


@lru_cache(maxsize=2)
def _encoder(path: str | None):
    """The file's vocabulary, run by the faster of the two libraries that
    read it: a byte-level BPE merges by rank, and its ids are the ranks.
    Texts are data: the strings of special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken
    with open(path or public_tokenizers.path("byte_bpe_50k.json"),
              encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    to_byte = {c: b for b, c in enumerate(_byte_letters())}
    ranks = {bytes(to_byte[c] for c in token): i
             for token, i in model["model"]["vocab"].items()
             if token not in special}
    return tiktoken.Encoding("pack", pat_str=SPLIT, mergeable_ranks=ranks,
                             special_tokens={})


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 characters stand for themselves, the rest follow
    from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


# --- pieces ----------------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length int, ids binary"


def _tokenize(p: PackParams):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(
                zip(*rows, strict=True), kinds, strict=True)],
            names=[c.split()[0] for c in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(p.vocabulary)
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(),
                                 batch.column(1), strict=True):
                ids = np.array([*enc.encode_ordinary(text.as_py()),
                                p.end_id], "<u4")
                first = (len(ids) - 1) % p.capacity + 1
                at = [0, *range(first, len(ids) + 1, p.capacity)]
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    rows.append((doc, k, a, b - a, ids[a:b].tobytes()))
                    held += b - a
                    if held >= _IDS_PER_BATCH:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)
    return run


def tokenize(docs: DataFrame, params: PackParams = PackParams(),
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: row_id (unique), doc_id, piece (from 0), start
    (the document's ids before it), length, ids (little-endian unsigned
    32-bit), ids_crc32.  Stored, so that numbers stay as they are."""
    rows = C.own_columns(docs, {id_col: "doc_id", text_col: "text"}).select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with C.text_batches(docs.sparkSession):
        pieces = rows.mapInArrow(_tokenize(params), PIECES)
        return C.save(pieces.withColumns({
            "row_id": F.monotonically_increasing_id(),
            "ids_crc32": F.crc32("ids")}), "pack-pieces", "zstd")


# --- the plan ----------------------------------------------------------------

@dataclass
class _Bins:
    """Sequences ``first`` to ``first + count - 1`` with the same fill."""

    first: int
    count: int
    fill: int


class Plan:
    """Runs (length, first number, count, first sequence, per sequence,
    offset): of the pieces of a length, those numbered from ``first
    number`` on go ``per sequence`` to each sequence, one behind the other
    from ``offset``."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self._left = dict(counts)
        self._next = dict.fromkeys(counts, 0)
        self._gaps: dict[int, list[_Bins]] = {}
        for n in counts:
            if not 0 < n <= capacity:
                raise ValueError(f"a piece of {n} tokens doesn't fit")
        self._match(sorted((n for n in counts if 3 * n > capacity),
                           reverse=True))
        for n in sorted((n for n in counts if 3 * n <= capacity),
                        reverse=True):
            self._best_fit(n)

    def _put(self, n: int, count: int, seq: int, per: int, offset: int
             ) -> None:
        self.runs.append((n, self._next[n], count, seq, per, offset))
        self._next[n] += count
        self._left[n] -= count

    def _open(self, bins: _Bins) -> None:
        if bins.count and bins.fill < self.capacity:
            self._gaps.setdefault(self.capacity - bins.fill, []).append(bins)

    def _new(self, count: int, fill: int) -> _Bins:
        bins = _Bins(self.sequences, count, fill)
        self.sequences += count
        return bins

    def _match(self, large: list[int]) -> None:
        for n in large:
            for m in large:
                if not self._left[n]:
                    break
                if m > n or n + m > self.capacity or not self._left[m]:
                    continue
                pairs = (self._left[n] // 2 if m == n
                         else min(self._left[n], self._left[m]))
                if not pairs:
                    continue
                if m == n:
                    bins = self._new(pairs, 2 * n)
                    self._put(n, 2 * pairs, bins.first, 2, 0)
                else:
                    bins = self._new(pairs, n + m)
                    self._put(n, pairs, bins.first, 1, 0)
                    self._put(m, pairs, bins.first, 1, n)
                self._open(bins)
            if self._left[n]:
                bins = self._new(self._left[n], n)
                self._put(n, self._left[n], bins.first, 1, 0)
                self._open(bins)

    def _best_fit(self, n: int) -> None:
        """A sequence that has taken one piece has the tightest gap for the
        next one, so it takes as many as it holds before another does."""
        while self._left[n]:
            gap = min((g for g in self._gaps if g >= n), default=None)
            if gap is None:
                per = self.capacity // n
                bins = self._new(-(-self._left[n] // per), 0)
            else:
                bins = self._gaps[gap].pop()
                if not self._gaps[gap]:
                    del self._gaps[gap]
                per = gap // n
            whole = min(bins.count, self._left[n] // per)
            if whole:
                self._put(n, whole * per, bins.first, per, bins.fill)
                self._open(_Bins(bins.first, whole, bins.fill + per * n))
            rest = _Bins(bins.first + whole, bins.count - whole, bins.fill)
            last = self._left[n]
            if rest.count and last and last < per:
                self._put(n, last, rest.first, last, rest.fill)
                self._open(_Bins(rest.first, 1, rest.fill + last * n))
                rest = _Bins(rest.first + 1, rest.count - 1, rest.fill)
            self._open(rest)


def _place(plan: Plan, columns: list[str]):
    """Adds the sequence and the offset that the runs give a piece."""
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    wide = np.int64(1) << 48        # numbers of a length stay far below it
    keys = runs[:, 0] * wide + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy()
            r = runs[np.searchsorted(keys, length * wide + number,
                                     "right") - 1]
            k = number - r[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns],
                 pa.array(r[:, 3] + k // r[:, 4]),
                 pa.array(r[:, 5] + k % r[:, 4] * length)],
                names=[*columns, "sequence_id", "offset"])
    return run


def _numbered(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``number``: the piece's place among those of its length."""
    buckets = [1] * (max(counts, default=0) + 1)
    for n, c in counts.items():
        buckets[n] = C.hash_buckets(c)
    many = F.element_at(F.array(*[F.lit(b) for b in buckets]),
                        F.col("length") + 1)
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("row_id"), many))
    key = ["length", "bucket"]
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    totals = (rows.groupBy(*key).agg(F.count("*").alias("c"))
              .withColumn("before", F.coalesce(F.sum("c").over(before),
                                               F.lit(0)))
              .select(*key, "before"))
    inside = Window.partitionBy(*key).orderBy("row_id")
    return (rows.withColumn("r", F.row_number().over(inside) - 1)
            .join(totals, key)
            .withColumn("number", F.col("r") + F.col("before"))
            .drop("r", "before", "bucket"))


def plan_of(pieces: DataFrame, params: PackParams) -> tuple[Plan, dict]:
    counts = {r["length"]: r["c"] for r in pieces.groupBy("length").agg(
        F.count("*").alias("c")).collect()}
    return Plan(counts, params.capacity), counts


def pack(docs: DataFrame, params: PackParams = PackParams(),
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: row_id, doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.  ``sequences`` makes the sequences themselves.

    A null text is an empty one: a document of its end id alone.  Repeated
    rows and rows without an id are documents of their own.  An empty
    table gives no row.  Every sequence is filled from 0 without gaps.
    Other columns are not read.
    """
    return C.result_of(
        lambda: places(tokenize(docs, params, id_col, text_col), params),
        docs.sparkSession, "pack")


def places(pieces: DataFrame, params: PackParams = PackParams()
           ) -> DataFrame:
    """Where each piece of ``tokenize`` goes (see ``pack``)."""
    plan, counts = plan_of(pieces, params)
    names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"]
    rows = _numbered(pieces.select(*names), counts)
    return rows.mapInArrow(
        _place(plan, names), "row_id long, doc_id long, piece int, "
        "start long, length int, ids_crc32 long, sequence_id long, "
        "offset long")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The training sequences: sequence_id, n_tokens, ids (binary), and
    per piece its doc_id, offset and length.  A sequence holds at most
    ``capacity`` pieces, so no group is large."""
    rows = placed.select("row_id", "sequence_id", "offset", "doc_id",
                         "length").join(
        pieces.select("row_id", "ids"), "row_id")
    part = F.struct("offset", "length", "doc_id", "ids")
    packed = rows.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(part)).alias("parts"))
    return packed.select(
        "sequence_id", F.aggregate("parts", F.lit(0), lambda n, x: n + x[
            "length"]).alias("n_tokens"),
        F.aggregate("parts", F.lit(b"").cast("binary"),
                    lambda s, x: F.concat(s, x["ids"])).alias("ids"),
        F.transform("parts", lambda x: F.struct(
            x["doc_id"], x["offset"], x["length"])).alias("pieces"))
