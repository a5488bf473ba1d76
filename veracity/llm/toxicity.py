"""Toxicity scores of texts restored from obfuscation.

A noisy channel: somebody meant plain letters and wrote leetspeak, put
separators between letters or repeated them.  A character trigram model,
counted over the whole corpus, says which letters are likely; a Viterbi
search over the lattice of what each written character can stand for
(itself, a letter it resembles, nothing when it separates or repeats)
restores the likeliest text.  Every word with a letter whose lattice has
more than one path is searched, once per distinct word; single letters,
look-alikes and separators in a row are searched as one.

The restored words are matched against a lexicon of words and word
beginnings learnt from labelled documents, and a logistic model of the
matches gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .minhash import MinHashParams, near_duplicates

# --- fixed values: characters written for letters they resemble ---
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g",
        "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
        "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
SEPARATORS = " .-_*~'"
# --- end of fixed values ---
CLASSES = 28            # 0: no letter, 1-26: a-z, 27: any other letter
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27

# A letter twice in a row, or any look-alike or separator: more than one path.
_PATHS = re.compile(rf"([^\W\d_])\1|[{re.escape(''.join(LEET) + SEPARATORS)}]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_DOUBLE = re.compile(r"(.)\1")
_OPENING, _CLOSING = "\"'[", ".,;:!?\"')]"
_EDGES_LEET = re.compile(r"^[^\w@$|+€£(¡!]+|[^\w@$|+€£]+$")


@dataclass(frozen=True)
class ToxicityParams:
    """``sample_rows`` bounds the labelled documents that the classifier is
    fitted on (the smallest hashes of the id); the character model, and
    the scoring, cover every document."""

    sample_rows: int = 20_000
    threshold: float = 0.7
    symbol_cost: float = 3.0
    leet_cost: float = 0.4
    repeat_cost: float = 0.8
    space_cost: float = 0.2
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8)
    min_support: int = 5
    min_precision: float = 0.95
    chance: float = 1e-3
    seed: int = 17


# --- character model -----------------------------------------------------

def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES ** 3, np.int64)
    for batch in batches:
        data, off = C.texts_of(batch.column(0))
        for a in range(int(off[0]), int(off[-1]), C.BLOCK):
            c = _CLASS[data[a:min(a + C.BLOCK, int(off[-1])) + 2]].astype(
                np.int32)
            if len(c) > 2:
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES
                                     + c[2:], minlength=CLASSES ** 3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)), pa.array(total[at])],
        names=["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(c | a, b) for the 28 character classes, counted over all of
    ``docs``.  What reaches the driver is one number per trigram of
    classes (at most 28 cubed), summed on Spark."""
    rows = docs.select(F.col(text_col).cast("binary").alias("text")).where(
        "text IS NOT NULL")
    with C.text_batches(docs.sparkSession):
        counts = rows.mapInArrow(_trigrams, "gram int, n long").groupBy(
            "gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES ** 3)
    for r in counts:
        n[r["gram"]] = r["n"]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    # smoothed with the bigram, and that with the single character
    one = n.sum(axis=(0, 1)) + 1.0
    one = one / one.sum()
    two = n.sum(axis=0) + 5.0 * one[None, :]
    two = two / two.sum(axis=1, keepdims=True)
    three = n + 5.0 * two[None, :, :]
    return np.log(three / three.sum(axis=2, keepdims=True))


# --- channel -------------------------------------------------------------

def _class(ch: str) -> int:
    if "a" <= ch <= "z":
        return ord(ch) - 96
    return 27 if ch.isalpha() else 0


def restore(span: str, model, p: ToxicityParams) -> str:
    """The likeliest plain text of a written span (lower case).

    A state is the last two restored classes; each keeps its best path as
    a chain of letters, so the work grows with the span's length only.  Of
    equally likely texts the first in code point order is taken."""
    states: dict = {(0, 0): (0.0, None)}
    before = ""
    for ch in span:
        options = []
        if ch.isalpha():
            options.append((ch, 0.0))
        else:
            options.append((" ", p.symbol_cost if ch in LEET else 0.0))
            options += [(x, p.leet_cost) for x in LEET.get(ch, "")]
            if ch in SEPARATORS:
                options.append(("", p.space_cost))
        if ch == before:
            options.append(("", p.repeat_cost))
        new: dict = {}
        for (a, b), (cost, path) in states.items():
            for x, price in options:
                if not x:
                    state, c, path2 = (a, b), cost + price, path
                else:
                    k = _class(x)
                    state, c = (b, k), cost + price - model[a][b][k]
                    path2 = (path, x)
                old = new.get(state)
                if old is None or c < old[0]:
                    new[state] = (c, path2)
        states, before = new, ch
    end = [(c - model[a][b][0], path) for (a, b), (c, path) in states.items()]
    least = min(c for c, _ in end)
    return min(_written(path) for c, path in end if c == least)


def _written(path) -> str:
    out = []
    while path is not None:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


@dataclass
class Reader:
    """Words of a text as the features they show.

    ``known`` keeps what was worked out per written word; it is emptied
    when it holds ``limit`` words."""

    model: list
    params: ToxicityParams
    limit: int = 200_000
    known: dict = field(default_factory=dict)
    SINGLE = ("\0",)

    def plain(self, word: str) -> str:
        """The word as it was meant; letters alone, none of them twice in
        a row, are what they are, and so is a word without a letter."""
        core = word.lstrip(_OPENING).rstrip(_CLOSING)
        if core.isalpha() and not _DOUBLE.search(core):
            return core
        span = _EDGES_LEET.sub("", word)
        if _PATHS.search(span) and any(map(str.isalpha, span)):
            return restore(span, self.model, self.params)
        return _EDGES.sub("", word)

    def features(self, word: str) -> tuple[str, ...]:
        if _single(word) is not None:
            return self.SINGLE
        plain = self.plain(word)
        if plain.isalpha():
            return (self.SINGLE if len(plain) == 1
                    else tuple(dict.fromkeys(self._of_word(plain))))
        out = []
        for w in re.split(r"[^\w]+|_", plain):
            out += self._of_word(w)
        return tuple(dict.fromkeys(out))

    def hits(self, word: str, lexicon: set[str], heads: set[str]
             ) -> tuple[str, ...] | None:
        """The word's features that are in the lexicon; ``heads`` are the
        first three letters of its entries."""
        if _single(word) is not None:
            return self.SINGLE
        plain = self.plain(word)
        if len(plain) > 1 and plain[:3] not in heads and plain.isalpha():
            return None
        f = self.features(word)
        if f == self.SINGLE:
            return f
        return tuple(lexicon.intersection(f)) or None

    def _of_word(self, w: str) -> list[str]:
        if len(w) < 3:
            return []
        return [w, *(w[:k] + "*" for k in self.params.prefixes
                     if len(w) >= k)]

    def words(self, text: str) -> list[tuple[str, ...]]:
        known = self.known
        out = []
        for w in text.lower().split():
            f = known.get(w)
            if f is None:
                if len(known) >= self.limit:
                    known.clear()
                f = known[w] = self.features(w)
            out.append(f)
        return out

    def spaced(self, text_words: list[str]) -> tuple[str, ...]:
        """Features of a run of single characters, one word each, and of
        the runs of letters alone in it."""
        chars = [_EDGES.sub("", w) if (c := _single(w)) is None else c
                 for w in text_words]
        runs, letters = [chars], [c.isalpha() for c in chars]
        if not any(letters):
            return ()
        if not all(letters):
            runs += [chars[a:b] for a, b in _runs(letters, True)]
        out = []
        for run in runs:
            for w in restore(" ".join(run), self.model, self.params).split():
                out += self._of_word(w)
        return tuple(out if len(runs) == 1 else dict.fromkeys(out))


def _single(word: str) -> str | None:
    """The letter or look-alike that a word consists of, "" for one of
    separators alone, None for any other word."""
    core = word.lstrip(_OPENING).rstrip(_CLOSING)
    for x in (word, core):
        if len(x) == 1 and (x.isalpha() or x in LEET):
            return x
    return None if word.strip(SEPARATORS) else ""


def _runs(feats: list, single) -> Iterator[tuple[int, int]]:
    """Runs of three single characters or more."""
    i = 0
    n = len(feats)
    while i < n:
        if feats[i] is single or feats[i] == single:
            j = i + 1
            while j < n and feats[j] == single:
                j += 1
            if j - i >= 3:
                yield i, j
            i = j
        else:
            i += 1


def document_features(reader: Reader, text: str) -> Counter:
    feats = reader.words(text)
    single = Reader.SINGLE
    count = Counter()
    if single in set(feats):
        words = text.lower().split()
        for a, b in _runs(feats, single):
            count.update(reader.spaced(words[a:b]))
    for f, n in Counter(feats).items():
        if f and f != single:
            for x in f:
                count[x] += n
    return count


# --- learning ------------------------------------------------------------

@dataclass
class ToxicityModel:
    characters: np.ndarray
    lexicon: tuple[str, ...]
    weights: np.ndarray
    params: ToxicityParams


def _signals(hits: int, distinct: int, words: int) -> list[float]:
    return [1.0, float(hits > 0), math.log1p(hits), math.log1p(distinct),
            math.log1p(hits) / math.log(words + 3.0)]


def _count_features(w, p: ToxicityParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(w.value, p)
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for y, t in zip(batch.column(1).to_pylist(),
                            batch.column(2).to_pylist(), strict=True):
                for x in document_features(reader, t):
                    counts.setdefault(x, [0, 0])[y] += 1
        names = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()),
             pa.array([counts[x][0] for x in names], pa.int64()),
             pa.array([counts[x][1] for x in names], pa.int64())],
            names=["feature", "clean", "toxic"])
    return run


def _hits(w, p: ToxicityParams, keep):
    """doc_id, label, words, and the (feature, count) pairs it shows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, wanted = Reader(w.value, p), keep.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = []
            for t in texts:
                f = document_features(reader, t)
                found.append(sorted(wanted[x] for x in f if x in wanted))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([len(t.split()) for t in texts],
                                           pa.int64()),
                 pa.array(found, pa.list_(pa.int32()))],
                names=["label", "words", "found"])
    return run


def _lexicon(rows: list, names: list[str], n_features: int,
             p: ToxicityParams) -> list[int]:
    """Features that tell toxic documents.

    First those in so many of them, and hardly any other, that chance
    would bring up one among all features with probability ``chance``.
    Then, for the toxic documents without any, the ones that explain most
    of what is left: a word that only comes along with a chosen one adds
    nothing and stays out."""
    toxic = [set(r["found"]) for r in rows if r["label"] == 1]
    clean = Counter(x for r in rows if r["label"] == 0 for x in r["found"])
    where: dict[int, set[int]] = {}
    for i, s in enumerate(toxic):
        for x in s:
            where.setdefault(x, set()).add(i)
    rate = min(max(len(toxic) / max(len(rows), 1), 1e-3), 0.5)
    sure = math.log(n_features / p.chance + 1) / -math.log(rate)
    chosen = sorted(x for x in where if len(where[x]) >= max(
        sure, p.min_support) and len(where[x]) >= p.min_precision * (
        len(where[x]) + clean[x]))
    left = set(range(len(toxic)))
    for x in chosen:
        left -= where.pop(x)
    while True:
        def worth(x):
            new = len(where[x] & left)
            return (new, new / (new + clean[x]), len(names[x]), names[x])
        good = [x for x in where if len(where[x] & left) >= p.min_support
                and len(where[x]) >= p.min_precision * (
                    len(where[x]) + clean[x])]
        if not good:
            return chosen
        best = max(good, key=worth)
        chosen.append(best)
        left -= where.pop(best)
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2
              ) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - q) - ridge * w
        h = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame,
        params: ToxicityParams = ToxicityParams(), id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Character model of all ``docs``; lexicon and weights from a bounded
    sample of the labelled ones.  Rows whose label is neither 0 nor 1 are
    left out; without any labelled document every score is the base rate
    of none."""
    with C.scratch_tables(docs.sparkSession):
        return _fit(docs, labels, params, id_col, text_col, label_col)


def _fit(docs, labels, p, id_col, text_col, label_col) -> ToxicityModel:
    spark = docs.sparkSession
    chars = character_model(docs, text_col)
    y = labels.select(F.col(id_col).cast("long").alias("id"),
                      F.col(label_col).cast("int").alias("y")).where(
        "y IN (0, 1) AND id IS NOT NULL")
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    sample = C.cut(y.orderBy(F.xxhash64(F.lit(p.seed), "id"), "id")
                   .limit(p.sample_rows))
    d = C.own_columns(docs, {id_col: "id", text_col: "text"}).select(
        F.col("id").cast("long"), F.coalesce(F.col("text").cast("string"),
                                             F.lit("")).alias("text"))
    # a group of near copies counts once
    rows = C.save(d.join(F.broadcast(sample), "id").select("id", "y", "text"),
                  "toxicity-sample")
    kept = near_duplicates(rows, MinHashParams(shingle=2), "id").where("kept")
    rows = C.save(rows.join(kept.select(F.col("doc_id").alias("id")), "id",
                            "left_semi"), "toxicity-distinct")
    w = spark.sparkContext.broadcast(chars.tolist())
    with C.text_batches(spark):
        counts = rows.mapInArrow(
            _count_features(w, p), "feature string, clean long, toxic long")
        counts = counts.groupBy("feature").agg(
            F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        counts = C.cut(counts)
        n_features = counts.count()
        names = [r["feature"] for r in counts.where(
            (F.col("toxic") >= p.min_support)
            & (F.col("toxic") >= p.min_precision * (
                F.col("toxic") + F.col("clean"))))
            .orderBy(F.desc("toxic"), "feature").select("feature").collect()]
        keep = spark.sparkContext.broadcast(
            {x: i for i, x in enumerate(names)})
        seen = rows.mapInArrow(
            _hits(w, p, keep), "label int, words long, found array<int>"
        ).collect()
    chosen = _lexicon(seen, names, n_features, p)
    lexicon = tuple(names[x] for x in chosen)
    picked = set(chosen)
    if not seen:
        return ToxicityModel(chars, (), np.array([-3.0, 0, 0, 0, 0]), p)
    x = np.array([_signals(len(picked.intersection(r["found"])),
                           len(picked.intersection(r["found"])), r["words"])
                  for r in seen])
    t = np.array([r["label"] for r in seen], float)
    return ToxicityModel(chars, lexicon, _logistic(x, t), p)


# --- scoring -------------------------------------------------------------

def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        reader = Reader(m.characters.tolist(), m.params)
        lexicon, heads = set(m.lexicon), {x[:3] for x in m.lexicon}
        single = Reader.SINGLE
        known: dict[str, tuple[str, ...] | None] = {}
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                words = text.lower().split()
                found, singles = set(), set()
                for w in set(words):
                    f = known.get(w, 0)
                    if f == 0:
                        if len(known) >= reader.limit:
                            known.clear()
                        f = known[w] = reader.hits(w, lexicon, heads)
                    if f is not None:
                        if f == single:
                            singles.add(w)
                        else:
                            found.update(f)
                if singles:
                    feats = [single if w in singles else () for w in words]
                    for a, b in _runs(feats, single):
                        found.update(lexicon.intersection(
                            reader.spaced(words[a:b])))
                z = float(np.dot(m.weights, _signals(
                    len(found), len(found), len(words))))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())],
                names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted for every row of ``docs``.

    A null text scores like an empty one; rows are scored one by one, so
    repeated ids, null ids and other columns make no difference."""
    p = model.params
    spark = docs.sparkSession
    rows = C.own_columns(docs, {id_col: "doc_id", text_col: "text"}).select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    m = spark.sparkContext.broadcast(model)
    with C.text_batches(spark):
        out = C.save(rows.mapInArrow(_score(m), "doc_id long, score double"),
                     "toxicity")
    return out.withColumn("predicted", (F.col("score") >= p.threshold)
                          .cast("int"))


def held_out(doc_id: str) -> Column:
    """Rows that no label is learnt from: crc32(doc_id as text) mod 3 = 1."""
    text = F.col(doc_id).cast("long").cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame,
             params: ToxicityParams = ToxicityParams(),
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the labels that aren't held out and score all documents:
    doc_id, held_out, score, predicted."""
    model = fit(docs, labels.where(~held_out(id_col)), params, id_col,
                text_col)
    return score(docs, model, id_col, text_col).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame,
                 params: ToxicityParams = ToxicityParams(),
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted toxic, each row by its own text:
    ids, null or repeated ones included, don't matter."""
    model = fit(docs, labels.where(~held_out(id_col)), params, id_col,
                text_col)
    return C.without_texts(docs, lambda rows: score(rows, model).where(
        "predicted = 1"), text_col)
