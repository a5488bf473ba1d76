"""Phrase counts, scores and drops against plain Python."""

import random
import re
from collections import Counter

import pytest

from veracity.llm import collocations as K

from .cases import empty, frame, rows

_AZ = {c: c + 32 for c in range(65, 91)}


def brute(docs, p):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(_AZ)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, p.words + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i:i + size])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= p.min_count}
    cover = Counter()
    for (lang, w), a in cand.items():
        for s in range(2, len(w)):
            for i in range(len(w) - s + 1):
                key = lang, w[i:i + s]
                cover[key] = max(cover[key], a)
    out = []
    for (lang, w), a in cand.items():
        if 100 * cover[lang, w] >= p.share * a:
            continue
        score, _, le, r = min(
            (2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k,
             f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), le, r))
    rank, res = Counter(), []
    for lang, s, a, w, le, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= p.top:
            res.append((lang, rank[lang], w.decode(), -a, le, r, n[lang], -s))
    return sorted(res)


def run(spark, docs, p):
    df = spark.createDataFrame(
        [(t, la, "x", 1, 2) for la, t in docs],
        "text string, lang string, phrase string, f int, n int")
    return sorted(tuple(r) for r in K.collocations(
        df.repartition(5), p).collect())


def random_docs(seed, n):
    r = random.Random(seed)
    voc = ["the", "The", "of", "a", "é", "naïve", "x" * 40, "don't", "q "]
    voc += [f"w{k}" for k in range(12)]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "!\n", " ; ", "\x0b", "? "]
    docs = [(r.choice(["en", "fr", None, "und"]), "".join(
        r.choice(voc) + r.choice(seps) for _ in range(r.randint(0, 120))))
        for _ in range(n)]
    return docs + [docs[0]] * 40 + [(None, None), ("en", ""), ("en", " .. ")]


@pytest.mark.parametrize("seed,period,longest", [(1, 16, 64), (2, 2, 1),
                                                 (3, 1000, 5)])
def test_equals_counting_everything(spark, seed, period, longest):
    p = K.CollocationParams(min_count=6, top=60, period=period,
                            longest=longest)
    docs = random_docs(seed, 150)
    want = brute(docs, p)
    assert len(want) > 100
    assert run(spark, docs, p) == want


def test_a_full_bitmap_only_marks_too_much(spark):
    p = K.CollocationParams(min_count=12, top=500, bitmap_bits=32)
    docs = random_docs(4, 100)
    assert run(spark, docs, p) == brute(docs, p)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    """Cuts at breaks, between words, and inside no word: the parse in one
    process, block by block."""
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(K, "BLOCK", 64)
    r = random.Random(8)
    long = " ".join(r.choice(["aa", "bb", "cc"]) for _ in range(400))
    texts = [long, "y" * 500 + " aa bb " + "z" * 300, "aa bb. " * 60,
             "short", "", "aa", " " * 200 + "aa bb" + "\t" * 99]
    p = K.CollocationParams(period=4, longest=8)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * len(texts)),
         pa.array([t.encode() for t in texts], pa.binary())],
        names=["lang", "text"])
    got = Counter()
    for b in K._parse(p)(iter([batch])):
        for own, chunk in zip(b.column(1).to_pylist(),
                              b.column(2).to_pylist(), strict=True):
            w = chunk.decode().split()
            assert own <= 8 and len(w) <= own + 3
            for i in range(own):
                for size in range(1, 5):
                    if i + size <= len(w):
                        got[tuple(w[i:i + size])] += 1
    want = Counter()
    for t in texts:
        for piece in re.split("[.]", t):
            w = piece.split()
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    want[tuple(w[i:i + size])] += 1
    assert got == want
    assert np.all(np.array(list(got.values())) > 0)


def test_cases_and_empty_table(spark):
    p = K.CollocationParams(min_count=2, top=2000)
    got = sorted(tuple(r) for r in K.collocations(frame(spark), p).collect())
    want = brute([(la, t) for _, t, la, *_ in rows()], p)
    assert got == want and got
    assert K.collocations(empty(spark)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9 * 10 ** 17
    levels = [spark.createDataFrame(d, "lang string, phrase string, f long")
              for d in ([("en", "a", big), ("en", "b", big - 1)],
                        [("en", "a b", big - 2)], [], [])]
    got = K.scored(levels).first()
    assert got["score"] == 2_000_000 * (big - 2) // (2 * big - 1)


def test_repeated_passages_are_one_entry(spark):
    text = " ".join(f"v{k}" for k in range(300))
    df = spark.createDataFrame([(text, "en")] * 200,
                               "text string, lang string")
    d = K.parse_dictionary(df.repartition(6)).collect()
    assert sum(r["own"] for r in d) == 300
    assert {r["freq"] for r in d} == {200}
