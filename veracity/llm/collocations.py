"""Phrase collocations, counted on a prefix-free parse of the corpus.

A text is lower-cased (A-Z), split at punctuation into pieces and those
into words.  The parse cuts a piece before every trigger word (one whose
hash is 0 modulo ``period``, so equal passages are cut alike wherever
they stand) and, in a run without one, after ``longest`` words.  A chunk
holds its own words and up to three words that follow, so consecutive
chunks overlap; a phrase belongs to the chunk that owns its first word
and lies in it whole, so every occurrence is counted once.

The distinct chunks with their parse frequencies are the dictionary.  All
counting runs on the dictionary, weighted by frequency: a passage that a
million documents share is one entry.

Phrases of n words are sifted level by level.  One that occurs often
enough consists of two shorter ones that do, so a level counts only the
places whose two shorter phrases are marked in a bitmap of the level
before, by a hash of the phrase.  Hashes that meet add up, and a bitmap has
a fixed largest size: both may let too much through, never too little.
A last pass counts what is marked by its text, so the counts are exact.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
BLOCK = 1 << 20
WORD, SPACE, BREAK = 0, 1, 2
# --- fixed values: what ends a word, and what ends a piece ---
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = SPACE
_KIND[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = BREAK
_INSIDE = rb"[^ \t.,;:!?\n\x0b\x0c\r]"
# --- end of fixed values ---
_REST_OF_WORD = re.compile(_INSIDE + rb"*")


@dataclass(frozen=True)
class CollocationParams:
    """``share``: a phrase goes if a longer one has so many percent of its
    occurrences.  ``bitmap_bits``: the largest bitmap, a power of two."""

    words: int = 4
    min_count: int = 30
    share: int = 80
    top: int = 2000
    period: int = 16
    longest: int = 64
    bitmap_bits: int = 1 << 27


# --- the parse ---------------------------------------------------------------

def _stretches(data: np.ndarray, offsets: np.ndarray, ahead: re.Pattern
               ) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, stop): words that start in lo to hi are owned, bytes up to
    ``stop`` are seen.  Whole texts of together about a block; a longer
    text is cut at a break, else between words with the overlap seen."""
    for a, b in C.row_chunks(offsets, BLOCK):
        lo, end = int(offsets[a]), int(offsets[b])
        while end - lo > BLOCK:
            kind = _KIND[data[lo:lo + BLOCK]]
            at = np.flatnonzero(kind == BREAK)
            if len(at):
                hi = stop = lo + int(at[-1]) + 1
            else:
                at = np.flatnonzero(kind == SPACE)
                hi = (lo + int(at[-1]) + 1 if len(at) else
                      _REST_OF_WORD.match(data, lo + BLOCK, end).end())
                stop = ahead.match(data, hi, end).end()
            yield lo, hi, stop
            lo = hi
        yield lo, end, end


def _words(b: np.ndarray, inside: np.ndarray, borders: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words; none crosses a border."""
    first = np.zeros(len(b) + 1, bool)
    first[borders] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    s = np.flatnonzero(inside & (~before | first[:-1]))
    e = np.flatnonzero(inside & (~after | first[1:])) + 1
    return s, e, _hashes(b, s, e)


def _hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(C._BYTE[b] * C._powers(C._BASE, len(b)), out=sums[1:])
    back = C._powers(C._BASE_INV, len(b) + 1)
    return C.mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))


def _gather(b: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray,
            last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts: text t is words first[t] to last[t] - 1,
    each followed by one space."""
    n = last - first
    word = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    size = (e - s)[word] + 1
    out = np.concatenate([[0], np.cumsum(size)])
    src = np.repeat(s[word] - out[:-1], size) + np.arange(out[-1])
    text = b[np.minimum(src, len(b) - 1)]
    text[out[1:] - 1] = 32
    return text, out[np.concatenate([[0], np.cumsum(n)])]


def _binary(text: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)])


def _parse(p: CollocationParams):
    ahead = re.compile(rb"(?:[ \t]*" + _INSIDE + rb"+){0,%d}" % (p.words - 1))

    def chunks(data, offsets, lo, hi, stop):
        """(row, own, text, text offsets) of the chunks of a stretch."""
        b = C._LOWER[data[lo:stop]]
        kind = _KIND[b]
        i, j = np.searchsorted(offsets, [lo, stop], "left")
        borders = offsets[i:j + 1]
        s, e, h = _words(b, kind == WORD, borders[borders <= stop] - lo)
        m = int(np.searchsorted(s, hi - lo))
        if not m:
            return None
        row = np.searchsorted(offsets, s + lo, "right") - 1
        breaks = np.cumsum(kind == BREAK)[s]
        new = np.ones(len(s), bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
        cut = (new | (h % U64(p.period) == 0))[:m]
        cut[0] = True
        at = np.arange(m)
        run = at - np.maximum.accumulate(np.where(cut, at, 0))
        first = np.flatnonzero(cut | (run % p.longest == 0))
        own = np.append(first[1:], m)
        piece = np.append(np.flatnonzero(new), len(s))
        last = np.minimum(own + p.words - 1, piece[
            np.searchsorted(piece, first, "right")])
        return row[first], own - first, *_gather(b, s, e, first, last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.texts_of(batch.column(1))
            for stretch in _stretches(data, offsets, ahead):
                found = chunks(data, offsets, *stretch)
                if found is None:
                    continue
                row, own, text, at = found
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)),
                     pa.array(own.astype(np.int32)), _binary(text, at)],
                    names=["lang", "own", "chunk"])
    return run


def parse_dictionary(docs: DataFrame,
                     params: CollocationParams = CollocationParams(),
                     text_col: str = "text", lang_col: str = "lang"
                     ) -> DataFrame:
    """Distinct chunks: lang, own (words), chunk (each word followed by a
    space), freq."""
    rows = C.own_columns(docs, {lang_col: "lang", text_col: "text"}).select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
        .alias("text"))
    return rows.mapInArrow(
        _parse(params), "lang string, own int, chunk binary").groupBy(
        "lang", "own", "chunk").agg(F.count("*").alias("freq"))


# --- counting on the dictionary ----------------------------------------------

def _lang_seeds(lang: pa.Array) -> np.ndarray:
    codes = lang.dictionary_encode()
    seeds = np.array([int.from_bytes(hashlib.blake2b(
        x.encode(), digest_size=8).digest(), "big")
        for x in codes.dictionary.to_pylist()], np.uint64)
    return seeds[codes.indices.to_numpy()]


def _gram_hashes(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (meaningless near the end)."""
    step = C._powers(0xD6E8FEB86659FD93, n)
    g = h.copy()
    for k in range(1, min(n, len(h))):
        g[:len(h) - k] += h[k:] * step[k]
    return C.mix(g + seeds + U64(n))


def _marked(g: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = g & U64(8 * len(marks) - 1)
    return (marks[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


@dataclass
class _Places:
    """The words of a stretch of the dictionary, in order."""

    text: np.ndarray
    start: np.ndarray       # of each word, and where it ends
    end: np.ndarray
    row: np.ndarray         # the chunk's row in the batch
    owned: np.ndarray
    after: np.ndarray       # words from this one on in the chunk
    hashes: np.ndarray
    seeds: np.ndarray

    def grams(self, n: int) -> np.ndarray:
        return _gram_hashes(self.hashes, self.seeds, n)


def _places(batch: pa.RecordBatch) -> Iterator[_Places]:
    """A batch (lang, own, chunk, freq) in stretches of about a block."""
    if not batch.num_rows:
        return
    data, offsets = C.texts_of(batch.column(2))
    seeds = _lang_seeds(batch.column(0))
    for a, b in C.row_chunks(offsets, BLOCK):
        lo = int(offsets[a])
        text = data[lo:int(offsets[b])]
        e = np.flatnonzero(text == 32)
        s = np.concatenate([[0], e[:-1] + 1])
        begin = np.searchsorted(s, offsets[a:b + 1] - lo)
        size = np.diff(begin)
        row = np.repeat(np.arange(a, b), size)
        place = np.arange(len(s)) - np.repeat(begin[:-1], size)
        yield _Places(text, s, e, row,
                      place < batch.column(1).to_numpy()[row],
                      np.repeat(size, size) - place, _hashes(text, s, e),
                      seeds[row])


def _summed(g: np.ndarray, freq: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, sum of freq, a place) per distinct hash."""
    order = np.argsort(g)
    g = g[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.add.reduceat(freq[order], first), order[first]


def _sift(n: int, marks: np.ndarray | None):
    """(h, f): hashes of the phrases of ``n`` words that chunks own, with
    their weighted counts in a stretch; only those whose two shorter
    phrases are marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _places(batch):
                ok = w.owned & (w.after >= n)
                if marks is not None:
                    short = _marked(w.grams(n - 1), marks)
                    ok[:-1] &= short[:-1] & short[1:]
                    ok[-1:] = False
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                g, f, _ = _summed(w.grams(n)[at],
                                  batch.column(3).to_numpy()[w.row[at]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(f)],
                    names=["h", "f"])
    return run


def _marked_phrases(marks: list[np.ndarray]):
    """(lang, phrase, size, f) of the phrases whose own hash is marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _places(batch):
                for n, bits in enumerate(marks, 1):
                    at = np.flatnonzero(w.owned & (w.after >= n))
                    g = w.grams(n)[at]
                    keep = _marked(g, bits)
                    at, g = at[keep], g[keep]
                    if not len(at):
                        continue
                    _, f, one = _summed(
                        g, batch.column(3).to_numpy()[w.row[at]])
                    at = at[one]
                    # words as they stand, without the space behind the last
                    length = w.end[at + n - 1] - w.start[at]
                    out = np.concatenate([[0], np.cumsum(length)])
                    src = np.repeat(w.start[at] - out[:-1], length
                                    ) + np.arange(out[-1])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(w.row[at])),
                         _binary(w.text[src], out),
                         pa.array(np.full(len(at), n, np.int32)),
                         pa.array(f)],
                        names=["lang", "phrase", "size", "f"])
    return run


def _bitmap(found: DataFrame, p: CollocationParams) -> np.ndarray:
    """Bits at the hashes: at least 32 per hash, while the largest size
    allows; never more than ``bitmap_bits`` altogether."""
    n = found.count()
    bits = min(p.bitmap_bits, 1 << max(16, math.ceil(math.log2(32 * n + 1))))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = (found.select(F.shiftright(at, 5).alias("w"), F.expr(
        f"shiftleft(1L, cast((h & {bits - 1}L) & 31 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    out = np.zeros(bits // 32, "<u4")
    out[words["w"].to_numpy()] = words["b"].to_numpy().astype("<u4")
    return out.view(np.uint8)


def phrase_counts(dictionary: DataFrame,
                  p: CollocationParams = CollocationParams()
                  ) -> list[DataFrame]:
    """Per number of words (from 1): lang, phrase, f, for all phrases with
    at least ``min_count`` occurrences."""
    rows = dictionary.select("lang", "own", "chunk", "freq")
    marks: list[np.ndarray] = []
    for n in range(1, p.words + 1):
        sums = rows.mapInArrow(_sift(n, marks[-1] if marks else None),
                               "h long, f long")
        often = C.save(sums.groupBy("h").agg(F.sum("f").alias("f")).where(
            F.col("f") >= p.min_count).select("h"), f"phrases-{n}")
        marks.append(_bitmap(often, p))
    counts = rows.mapInArrow(_marked_phrases(marks), "lang string, "
                             "phrase binary, size int, f long")
    counts = C.save(
        counts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
        .where(F.col("f") >= p.min_count)
        .withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    return [counts.where(F.col("size") == n).select("lang", "phrase", "f")
            for n in range(1, p.words + 1)]


# --- scores --------------------------------------------------------------------

def _join(words: str, start: str, length: str) -> str:
    return f"array_join(slice({words}, {start}, {length}), ' ')"


def scored(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, size, a, l, r, score of the lowest-scoring cut."""
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.union(level)
    cand = _candidates(levels)
    cuts = cand.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.withColumns({
        "head": F.expr(_join("w", "1", "k")),
        "rest": F.expr(_join("w", "k + 1", "size - k"))}).drop("w")
    head = counts.select("lang", F.col("phrase").alias("head"),
                         F.col("f").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"),
                         F.col("f").alias("r"))
    cuts = cuts.join(head, ["lang", "head"]).join(rest, ["lang", "rest"])
    # exact: products have up to 38 digits
    wide = "cast({} as decimal(38,0))"
    cuts = cuts.withColumn("score", F.expr(
        f"cast(({wide.format('a')} * 2000000) div "
        f"({wide.format('l')} + {wide.format('r')}) as long)"))
    low = cuts.groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return low.select("lang", "phrase", "size", "a", "cut.l", "cut.r",
                      "cut.score")


def _candidates(levels: list[DataFrame]) -> DataFrame:
    cand = levels[1]
    for level in levels[2:]:
        cand = cand.union(level)
    return cand.select("lang", "phrase", F.col("f").alias("a"),
                       F.split("phrase", " ").alias("w")).withColumn(
        "size", F.size("w"))


def _covered(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, cover: the most occurrences of a longer candidate
    that holds the phrase."""
    inner = _join("w", "i", "s")
    parts = F.expr("flatten(transform(sequence(2, size - 1), s -> transform("
                   f"sequence(1, size - s + 1), i -> {inner})))")
    return (_candidates(levels).where("size > 2")
            .select("lang", F.explode(parts).alias("phrase"), "a")
            .groupBy("lang", "phrase").agg(F.max("a").alias("cover")))


def collocations(docs: DataFrame,
                 params: CollocationParams = CollocationParams(),
                 text_col: str = "text", lang_col: str = "lang"
                 ) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r,
    n, score.

    a, l, r: occurrences of the phrase and of the two parts of its
    lowest-scoring cut (the smallest first part of equals); n: all words of
    the language; score = floor(2000000 a / (l + r)).  A null language is
    ``und``; a null or empty text has no words; repeated rows count each.
    A language without a frequent phrase has no row.  Other columns are
    not read.
    """
    return C.result_of(lambda: _collocations(docs, params, text_col,
                                             lang_col),
                       docs.sparkSession, "collocations")


def _collocations(docs, p: CollocationParams, text_col, lang_col
                  ) -> DataFrame:
    dictionary = C.save(parse_dictionary(docs, p, text_col, lang_col),
                        "phrase-chunks")
    total = dictionary.groupBy("lang").agg(
        F.sum(F.col("own") * F.col("freq")).alias("n"))
    levels = phrase_counts(dictionary, p)
    rows = scored(levels).join(_covered(levels), ["lang", "phrase"], "left")
    rows = C.save(rows.where(
        "cover IS NULL OR cast(cover as decimal(38,0)) * 100 < "
        f"cast(a as decimal(38,0)) * {p.share}").drop("cover", "size"),
        "phrases-scored")
    # the first of each part of a language, then of the language
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = 8 * max(1, math.ceil(math.sqrt(rows.count() / p.top)))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    best = (rows.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part")
                                    .orderBy(*order)))
        .where(F.col("rank") <= p.top).drop("part"))
    best = best.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order)).cast("long")
    ).where(F.col("rank") <= p.top)
    return best.join(total, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
