"""Packing: ids against the tokenizers library, places against a plain
version of the method, sequences whole."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracity.llm import packing as K

from .cases import empty, frame, rows


def _library():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def _pieces(text, capacity, t):
    ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
    n = len(ids)
    first = n - (-(-n // capacity) - 1) * capacity
    at = [0, *range(first, n + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            for k, (a, b) in enumerate(zip(at, at[1:]))]


def plain_method(lengths, capacity):
    """Number of sequences, piece by piece."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        n = large.pop(0)
        fits = next((m for m in large if n + m <= capacity), None)
        if fits is not None:
            large.remove(fits)
        gaps.append(capacity - n - (fits or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_the_method(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 30, 100])
    top = r.choice([capacity, max(1, capacity // 2), max(1, capacity // 4)])
    lengths = [r.randint(1, top) for _ in range(r.randint(0, 400))]
    lengths += [capacity] * r.randint(0, 50)
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = K.Plan(counts, capacity)
    assert plan.sequences == plain_method(lengths, capacity)
    # every number of every length once, every sequence gapless
    seen, filled = {}, {}
    for n, first, count, seq, per, offset in plan.runs:
        for k in range(count):
            seen.setdefault(n, []).append(first + k)
            filled.setdefault(seq + k // per, []).append(
                (offset + k % per * n, n))
    assert {n: sorted(v) for n, v in seen.items()} == {
        n: list(range(c)) for n, c in counts.items()}
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(filled) == list(range(plan.sequences))


def test_plan_of_many_is_as_small():
    counts = {n: 10 ** 9 + n for n in range(1, 1025)}
    plan = K.Plan(counts, 1024)
    assert len(plan.runs) < 100_000
    total = sum(n * c for n, c in counts.items())
    assert plan.sequences * 1024 < 1.02 * total


def test_pieces_and_places(spark):
    t = _library()
    got = K.pack(frame(spark).repartition(4)).collect()
    want = sorted(((i, *p) for i, text, *_ in rows()
                   for p in _pieces(text, 1024, t)), key=repr)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"],
                    r["ids_crc32"]) for r in got), key=repr) == want
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024
    assert len(at) == plain_method([r["length"] for r in got], 1024)


def test_sequences_hold_the_documents(spark):
    t = _library()
    df = frame(spark)
    pieces = K.tokenize(df, K.PackParams(capacity=100))
    placed = K.places(pieces, K.PackParams(capacity=100))
    seqs = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4")
            for r in K.sequences(pieces, placed).collect()}
    docs = {}
    for r in placed.collect():
        part = seqs[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]
        docs.setdefault((r["doc_id"], r["row_id"] if r["doc_id"] in (None, 10)
                         else 0), []).append((r["start"], part.tolist()))
    texts = {i: text for i, text, *_ in rows() if i not in (None, 10)}
    for (i, _), parts in docs.items():
        if i in texts:
            ids = [x for _, p in sorted(parts) for x in p]
            assert ids == [*t.encode(texts[i] or "",
                                     add_special_tokens=False).ids, 2]


def test_special_strings_are_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b")],
                               "doc_id long, text string")
    assert K.pack(df).first()["length"] > 4
    assert K.pack(empty(spark)).count() == 0


def test_a_common_length_is_no_single_window(spark):
    """Pieces are numbered in buckets: none holds many of one length."""
    pieces = spark.range(40_000).select(
        F.col("id").alias("row_id"), F.lit(7).alias("length"))
    got = K._numbered(pieces, {7: 40_000})
    assert got.agg(F.countDistinct("number"), F.max("number")).first() == (
        40_000, 39_999)
    assert "bucket" in got._jdf.queryExecution().toString()
