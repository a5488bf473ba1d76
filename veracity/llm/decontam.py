"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments.  A segment holds the postings of a few
hundred whole documents: its distinct terms in order and, per term, the
positions where it occurs, positions counted over the segment with a gap
between documents.  Segments are built in parallel, stored once, and each
can be searched on its own, so nothing is shuffled by term and a very
frequent word is no hot key.

The test items are stored, too, in blocks of a bounded number of words.
Blocks that together stay within a checked number of bytes are sent to all
segments at once; a larger test set is joined with the segments in Spark,
on a salt, so that a task holds one segment and one block.

A window whose terms aren't all in a segment is skipped at once.  For the
others the rarest term's list, shifted by the term's offset in the window,
gives the possible starts, and the lists of the next rarest terms cut them
down.

A proximity match is a start from which at least ``near_share`` of the
window's terms stand within ``slop`` places of where they should.  Of any
few terms more than may be lacking one must be there, so the rarest of
them, each with all the places it may stray, give all possible starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = C.U64


@dataclass(frozen=True)
class DecontamParams:
    """``segment_bytes``: text per index segment.  ``block_words``: test
    words per block.  ``broadcast_bytes``: blocks sent to every task.
    ``slop``: places a term may stray in a proximity match; None looks for
    phrases only.  ``near_share``: share of a window's terms that a
    proximity match needs."""

    window: int = 13
    percent: int = 5
    segment_bytes: int = 4 << 20
    block_words: int = 200_000
    broadcast_bytes: int = 16 << 20
    slop: int | None = None
    near_share: float = 0.8


SEGMENT_SCHEMA = ("segment long, ids binary, nulls binary, borders binary, "
                  "terms binary, counts binary, steps binary")
MATCH_SCHEMA = ("segment long, row int, doc_id long, n_words long, "
                "items array<string>, kinds array<string>, "
                "first array<long>, last array<long>")


def _build(p: DecontamParams):
    gap = p.window * 2 + 2 * (p.slop or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        segment = (task.partitionId() if task else 0) << 32
        for batch in batches:
            data, off = C.texts_of(batch.column(1))
            for a, b in C.row_chunks(off, p.segment_bytes):
                h, border = C.word_hashes(data, off[a:b + 1], C.ALNUM_WORDS)
                n = np.diff(border)
                base = border + gap * np.arange(len(border))
                where = np.arange(len(h)) + np.repeat(
                    gap * np.arange(b - a), n)
                order = np.argsort(h, kind="stable")
                h, where = h[order], where[order]
                starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])[
                    :len(h)])
                ids = batch.column(0).slice(a, b - a)
                rows = [ids.fill_null(0).to_numpy().astype(np.int64),
                        ids.is_null().to_numpy(zero_copy_only=False),
                        base.astype(np.int64), h[starts],
                        np.diff(starts, append=len(h)).astype(np.int32),
                        np.diff(where, prepend=0).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int64()),
                     *[pa.array([r.tobytes()], pa.binary()) for r in rows]],
                    names=[c.split()[0] for c in SEGMENT_SCHEMA.split(", ")])
                segment += 1
    return run


def build_index(docs: DataFrame, params: DecontamParams = DecontamParams(),
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored positional index of ``docs``, a row per segment.

    A null text has no words; a null id stays null.  Rows that repeat an
    id are documents of their own.
    """
    rows = C.own_columns(docs, {id_col: "doc_id", text_col: "text"}).select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    with C.text_batches(docs.sparkSession):
        return C.save(rows.mapInArrow(_build(params), SEGMENT_SCHEMA),
                      "positional-index", "zstd")


BLOCK_SCHEMA = "block long, items array<string>, hashes binary, cuts binary"


def _item_blocks(p: DecontamParams):
    """Items as word hashes, in blocks of about ``block_words`` words.  A
    longer item is cut into pieces that share all but one word of a
    window, so each of its windows is in one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        step = max(p.block_words, 2 * p.window)
        names, parts, words = [], [], 0

        def flush():
            nonlocal names, parts, words, block
            border = np.cumsum([0, *map(len, parts)]).astype(np.int64)
            out = pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()),
                 pa.array([names], pa.list_(pa.string())),
                 pa.array([np.concatenate(parts).tobytes()], pa.binary()),
                 pa.array([border.tobytes()], pa.binary())],
                names=["block", "items", "hashes", "cuts"])
            names, parts, words, block = [], [], 0, block + 1
            return out
        for batch in batches:
            data, off = C.texts_of(batch.column(1))
            items = batch.column(0).to_pylist()
            for a, b in C.row_chunks(off):
                h, border = C.word_hashes(data, off[a:b + 1], C.ALNUM_WORDS)
                for i in range(b - a):
                    w = h[border[i]:border[i + 1]]
                    at = 0
                    while at < len(w):
                        names.append(items[a + i])
                        parts.append(w[at:at + step])
                        words += len(parts[-1])
                        if words >= p.block_words:
                            yield flush()
                        if at + step >= len(w):
                            break
                        at += step - p.window + 1
        if parts:
            yield flush()
    return run


@dataclass
class _Windows:
    """Test windows as term numbers: rows of one length, padded with -1."""

    terms: np.ndarray       # distinct term hashes, sorted
    slots: np.ndarray       # windows x longest length, index into terms
    length: np.ndarray
    item: np.ndarray        # index into items
    items: list


def _windows(items: list, hashes: bytes, borders: bytes, p: DecontamParams
             ) -> _Windows:
    """Every run of ``window`` consecutive words of each item; an item of
    fewer is one window; an item without words has none."""
    border = np.frombuffer(borders, np.int64)
    terms, number = np.unique(np.frombuffer(hashes, np.uint64),
                              return_inverse=True)
    n = np.diff(border)
    count = np.where(n > 0, np.maximum(1, n - p.window + 1), 0)
    item = np.repeat(np.arange(len(n)), count)
    first = border[:-1][item] + np.arange(len(item)) - np.repeat(
        np.cumsum(count) - count, count)
    length = np.minimum(n, p.window)[item]
    at = first[:, None] + np.arange(p.window)[None, :]
    grid = np.where(np.arange(p.window)[None, :] < length[:, None],
                    number[np.minimum(at, max(len(number) - 1, 0))]
                    if len(number) else -1, -1)
    return _Windows(terms, grid.astype(np.int32), length, item, items)


def _between(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether a key lies in [lo, hi], for each of many ranges."""
    return np.searchsorted(keys, hi, "right") > np.searchsorted(keys, lo)


def _match(w: _Windows, terms, starts, positions, slop: int, need: float
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, a place in the document) of all matches in one
    segment.  ``need`` below 1: proximity matches."""
    none = np.empty(0, np.int64)
    if not len(terms) or not len(w.slots):
        return none, none, none
    at = np.minimum(np.searchsorted(terms, w.terms), len(terms) - 1)
    there = terms[at] == w.terms
    count = np.where(there, starts[at + 1] - starts[at], 0)
    most = np.iinfo(np.int32).max
    have = np.where(w.slots >= 0, count[w.slots], most)
    exact = need >= 1.0
    wanted = np.ceil(need * w.length - 1e-9).astype(np.int64)
    live = np.flatnonzero((have == 0).sum(axis=1) <= w.length - wanted)
    if not len(live):
        return none, none, none
    # postings of the test terms that occur, as sorted (term, position) keys
    used = np.unique(w.slots[live][w.slots[live] >= 0])
    used = used[count[used] > 0]
    keys = np.concatenate([
        positions[starts[at[t]]:starts[at[t] + 1]].astype(np.int64)
        + (int(t) << 32) for t in used.tolist()])
    # absent terms last, and behind them the places that are no terms
    rank = np.argsort(np.where(have[live] == 0, most - 1, have[live]),
                      axis=1, kind="stable")
    rarest = np.argsort(have[live], axis=1, kind="stable")
    found = []
    anchors = 1 if exact else int((w.length - wanted)[live].max()) + 1
    stray = np.arange(-slop, slop + 1)
    for nth in range(anchors):
        # of the ``lacking + 1`` rarest terms, absent ones among them, one
        # is within reach of any match
        off = (rank if exact else rarest)[:, nth]
        ok = (off < w.length[live]) & (have[live, off] > 0) & (
            nth <= (w.length - wanted)[live])
        n_ok = count[w.slots[live[ok], off[ok]]].sum() * len(stray)
        for rows in np.array_split(np.flatnonzero(ok),
                                   max(1, int(n_ok // 2_000_000))):
            if not len(rows):
                continue
            win, o = live[rows], off[rows]
            n = count[w.slots[win, o]]
            cand = np.repeat(np.arange(len(rows)), n)
            step = np.arange(len(cand)) - np.repeat(np.cumsum(n) - n, n)
            where = positions[starts[at[w.slots[win, o]]][cand] + step
                              ].astype(np.int64)
            if exact:
                start = where - o[cand]
            else:
                cand = np.repeat(cand, len(stray))
                where = np.repeat(where, len(stray))
                start = where - o[cand] + np.tile(stray, len(where)
                                                  // len(stray))
            hits = np.zeros(len(cand), np.int64)
            for k in range(w.slots.shape[1]):
                if not len(cand):
                    break
                if exact and k == 0:
                    continue
                # the rarest terms first: they leave fewest starts
                place = rank[rows][cand, k]
                inside = place < w.length[win[cand]]
                t = w.slots[win[cand], place]
                here = (np.maximum(t, 0).astype(np.int64) << 32) + start \
                    + place
                hit = _between(keys, here - slop, here + slop) & inside
                hits += hit
                # what can still be missed
                left = np.minimum(w.slots.shape[1], w.length[win[cand]]
                                  ) - k - 1
                keep = (hit | ~inside if exact
                        else hits + np.maximum(left, 0) >= wanted[win[cand]])
                cand, start = cand[keep], start[keep]
                where, hits = where[keep], hits[keep]
            found.append(np.stack([win[cand], start, where]))
    found = np.concatenate(found, axis=1) if found else np.empty((3, 0))
    found = found.astype(np.int64)
    _, first = np.unique(found[:2], axis=1, return_index=True)
    return tuple(found[:, first])


def _found(win: _Windows, p: DecontamParams, segment, base: bool
           ) -> pa.RecordBatch:
    """What one block finds in one segment; with ``base`` documents without
    a match have a row, too."""
    number, ids, nulls, borders, terms, counts, steps = segment
    starts = np.append(0, np.cumsum(counts))
    positions = np.cumsum(steps, dtype=np.int64)
    gap = p.window * 2 + 2 * (p.slop or 0)
    n_words = np.diff(borders) - gap
    kinds = [("phrase", *_match(win, terms, starts, positions, 0, 1.0))]
    if p.slop is not None:
        kinds.append(("proximity", *_match(win, terms, starts, positions,
                                           p.slop, p.near_share)))
    per_doc = [{} for _ in ids]
    for kind, window, start, where in kinds:
        doc = np.searchsorted(borders, where, "right") - 1
        order = np.lexsort((start, win.item[window], doc))
        first = np.maximum(start - borders[doc], 0)
        last = np.minimum(start - borders[doc] + win.length[window],
                          n_words[doc])
        for d, it, a, b in zip(
                doc[order].tolist(), win.item[window[order]].tolist(),
                first[order].tolist(), last[order].tolist(), strict=True):
            spans = per_doc[d].setdefault((kind, it), [])
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
    rows = [i for i, f in enumerate(per_doc) if f or base]
    cols = [[], [], [], []]
    for i in rows:
        flat = [(kind, win.items[it], a, b) for (kind, it), spans in
                sorted(per_doc[i].items()) for a, b in spans]
        cols[0].append(["null" if x[1] is None else x[1] for x in flat])
        cols[1].append([x[0] for x in flat])
        cols[2].append([x[2] for x in flat])
        cols[3].append([x[3] for x in flat])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(rows), number, np.int64)),
         pa.array(rows, pa.int32()),
         pa.array([None if nulls[i] else int(ids[i]) for i in rows],
                  pa.int64()),
         pa.array(n_words[rows].astype(np.int64)),
         pa.array(cols[0], pa.list_(pa.string())),
         pa.array(cols[1], pa.list_(pa.string())),
         pa.array(cols[2], pa.list_(pa.int64())),
         pa.array(cols[3], pa.list_(pa.int64()))],
        names=[c.split()[0] for c in MATCH_SCHEMA.split(", ")])


def _segment(batch: pa.RecordBatch, i: int) -> tuple:
    kinds = (np.int64, bool, np.int64, np.uint64, np.int32, np.int32)
    return (batch.column(0)[i].as_py(), *[
        np.frombuffer(batch.column(k)[i].as_buffer(), t)
        for k, t in enumerate(kinds, 1)])


def _search_all(w, p: DecontamParams):
    """Every segment with all blocks that were sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wins = [_windows(*b, p) for b in w.value] or [
            _windows([], b"", np.zeros(1, np.int64).tobytes(), p)]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = _segment(batch, i)
                for k, win in enumerate(wins):
                    yield _found(win, p, segment, k == 0)
    return run


def _search_pair(p: DecontamParams):
    """Rows of a segment and a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = [batch.column(c)[i] for c in
                         ("items", "hashes", "cuts")]
                win = _windows(block[0].as_py(), block[1].as_buffer(),
                               block[2].as_buffer(), p)
                yield _found(win, p, _segment(batch, i),
                             batch.column("base")[i].as_py())
    return run


def item_blocks(benchmark: DataFrame, params: DecontamParams =
                DecontamParams(), item_col: str = "item_id",
                text_col: str = "text") -> DataFrame:
    """The test items as stored blocks; items without words have none."""
    items = C.own_columns(benchmark, {item_col: "item_id", text_col: "text"}
                          ).select(F.col("item_id").cast("string"),
                                   F.col("text").cast("binary"))
    return C.save(items.mapInArrow(_item_blocks(params), BLOCK_SCHEMA),
                  "test-blocks")


def search(index: DataFrame, benchmark: DataFrame,
           params: DecontamParams = DecontamParams(),
           item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Matches of all items in all documents, one row per document:
    segment and row (its place in the index), doc_id, n_words and, per
    merged span, the item, the kind (phrase or proximity) and the words
    [first, last)."""
    p, spark = params, index.sparkSession
    blocks = item_blocks(benchmark, p, item_col, text_col)
    size = F.octet_length("hashes") + F.octet_length("cuts") + F.length(
        F.array_join("items", ","))
    n, total = blocks.agg(F.count("*"), F.sum(size)).first()
    if (total or 0) <= p.broadcast_bytes:
        w = spark.sparkContext.broadcast([
            (r["items"], bytes(r["hashes"]), bytes(r["cuts"]))
            for r in blocks.select("items", "hashes", "cuts").collect()])
        found = index.mapInArrow(_search_all(w, p), MATCH_SCHEMA)
    else:
        salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = blocks.withColumn("base", F.col("block") == F.lit(
            blocks.agg(F.min("block")).first()[0])).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = index.withColumn("salt", F.pmod(
            F.xxhash64("segment"), F.lit(salts)).cast("int"))
        found = salted.join(dealt.drop("block"), "salt").drop(
            "salt").mapInArrow(_search_pair(p), MATCH_SCHEMA)
    if n > 1:      # a document's spans of all blocks in one row
        key = ["segment", "row", "doc_id", "n_words"]
        found = found.groupBy(*key).agg(*[
            F.flatten(F.collect_list(c)).alias(c)
            for c in ("items", "kinds", "first", "last")])
    return C.save(found, "matches")


def _covered(spans: list) -> int:
    hit, end = 0, 0
    for a, b in sorted(spans):
        hit += max(0, b - max(a, end))
        end = max(end, b)
    return hit


DIGEST_SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, "
                 "items_sha256 string, n_near_hit long, n_near_items long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [[], [], [], [], []]
        for items, kinds, first, last in zip(*(
                batch.column(i).to_pylist() for i in range(2, 6)),
                strict=True):
            names = {"phrase": set(), "proximity": set()}
            spans = {"phrase": [], "proximity": []}
            for it, kind, a, b in zip(items, kinds, first, last, strict=True):
                names[kind].add(it)
                spans[kind].append((a, b))
            for c, x in zip(cols, (
                    _covered(spans["phrase"]), len(names["phrase"]),
                    hashlib.sha256(",".join(sorted(names["phrase"])).encode()
                                   ).hexdigest(),
                    _covered(spans["proximity"]), len(names["proximity"])),
                    strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()),
             pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
             pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
            names=[c.split()[0] for c in DIGEST_SCHEMA.split(", ")])


def contamination(docs: DataFrame, benchmark: DataFrame,
                  params: DecontamParams = DecontamParams(),
                  id_col: str = "doc_id", text_col: str = "text"
                  ) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated (hit words are ``percent`` of its words or more), and with
    a ``slop`` n_near_hit (words in proximity matches) and n_near_items.

    Words are runs of ASCII letters and digits and of anything beyond
    ASCII, A-Z lower-cased.  Null texts and items have no words; a null
    item id reads as 'null'.  An empty benchmark hits nothing.  Rows that
    repeat a doc_id are judged each on its own.
    """
    p = params

    def rows() -> DataFrame:
        index = build_index(docs, p, id_col, text_col)
        return search(index, benchmark, p).drop("segment", "row").mapInArrow(
            _digest, DIGEST_SCHEMA)
    out = C.result_of(rows, docs.sparkSession, "contamination")
    if p.slop is None:
        out = out.drop("n_near_hit", "n_near_items")
    return out.withColumn("contaminated", F.expr(
        f"n_hit > 0 AND 100 * n_hit >= {p.percent} * n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame,
                  params: DecontamParams = DecontamParams(),
                  id_col: str = "doc_id", text_col: str = "text"
                  ) -> DataFrame:
    """``docs`` without the contaminated ones, each row by its own text:
    ids, null or repeated ones included, don't matter."""
    return C.without_texts(docs, lambda rows: contamination(
        rows, benchmark, params).where("contaminated"), text_col)
