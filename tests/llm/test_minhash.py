"""MinHash near-duplicates against all pairs by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veracity.llm.minhash import (MinHashParams, _across, deduplicate,
                                  near_duplicates)

from . import cases


def shingle_set(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    if len(w) < width:
        return {tuple(w)}
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(docs, width, percent=80):
    """doc_id -> (size, component); docs are (id, text) with distinct ids."""
    sets = {i: shingle_set(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(i for i in sets if sets[i])
    for k, x in enumerate(ids):
        for y in ids[k + 1:]:
            both = len(sets[x] & sets[y])
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def variants(seed, n, base_words, edits):
    r = random.Random(seed)
    base = cases.words(seed, base_words)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = "e" + str(r.randrange(10 ** 6))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force(spark, width):
    docs = []
    for g, (n, words, edits) in enumerate(
            [(60, 80, 14), (5, 300, 30), (3, 8, 1), (20, 40, 8)]):
        docs += variants(g + 10 * width, n, words, edits)
    docs += [cases.text(500 + i, 30) for i in range(40)]
    random.Random(1).shuffle(docs)
    docs = list(enumerate(docs))
    want = brute(docs, width)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(
        df, MinHashParams(shingle=width)).collect()}
    assert got == want


def test_edge_rows(spark):
    got = near_duplicates(cases.frame(spark), MinHashParams(shingle=2)
                          ).collect()
    assert len(got) == len(cases.rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].component_id for i in (1, 2, 3)] == [1, 1, 1]
    assert [by[i].n_shingles for i in (4, 5, 6, 7, 11)] == [0, 0, 0, 1, 1]
    assert by[4].component_id == 4 and by[5].kept and by[6].kept
    assert by[8].component_id == 7 and not by[8].kept
    assert sum(r.doc_id == 10 and r.kept for r in got) == 2
    assert all(r.kept and r.component_id is None
               for r in got if r.doc_id is None)


def test_empty_table_and_dedup_keeps_columns(spark):
    assert near_duplicates(cases.empty(spark)).count() == 0
    out = deduplicate(cases.frame(spark), MinHashParams(shingle=2))
    assert out.columns == cases.frame(spark).columns
    ids = sorted(r.doc_id or 0 for r in out.collect())
    assert ids == [0, 0, 1, 4, 5, 6, 7, 9, 10, 11, 12]


def test_across_finds_links_beside_the_largest_component(spark):
    import numpy as np

    def raw(xs):
        return np.array(sorted(xs), np.uint64).tobytes()
    full = spark.createDataFrame(
        [(1, raw(range(10))), (2, raw(range(10))), (3, raw(range(50, 60))),
         (4, raw(range(50, 61))), (5, raw(range(11)))],
        "id long, elements binary")
    rows = spark.createDataFrame([(9, i, 5) for i in (1, 2, 3, 4, 5)],
                                 "key long, id long, c long")
    comp = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    got = {(r.a, r.b) for r in _across(rows, comp, full, MinHashParams()
                                       ).collect()}
    assert (3, 4) in got and got & {(1, 5), (2, 5)}
    assert not any({1, 2, 5} & set(p) and {3, 4} & set(p) for p in got)


def test_one_row_of_each_group_stays(spark):
    """A verdict is a row's: ids with two texts, rows without an id, rows
    repeated with and without other columns equal."""
    a, b, c = cases.text(71, 90), cases.text(72, 90), cases.text(73, 90)
    near = a.replace(a.split()[40], "changed", 1)
    rows = [(1, a, "x"), (5, near, "x"), (5, b, "x"), (5, b, "y"),
            (None, c, "x"), (None, c, "x"), (None, c, "y"),
            (None, a, "x"), (8, None, "x"), (8, None, "x"), (9, " ", "x"),
            (9, " ", "x"), (None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    got = sorted(((r.doc_id, r.text, r.other) for r in deduplicate(
        df.repartition(3)).collect()), key=repr)
    kept_c = [r for r in got if r[1] == c]
    assert len(kept_c) == 1
    assert [r for r in got if r[1] == b] in ([(5, b, "x")], [(5, b, "y")])
    rest = [r for r in got if r[1] not in (b, c)]
    assert rest == sorted([(1, a, "x"), (8, None, "x"), (8, None, "x"),
                           (9, " ", "x"), (9, " ", "x"), (None, None, "z")],
                          key=repr)


def test_the_whole_table_twice(spark):
    df = cases.frame(spark)
    once = deduplicate(df, MinHashParams(shingle=2))
    twice = deduplicate(df.union(df), MinHashParams(shingle=2))
    worded = F.length(F.trim(F.regexp_replace("text", "[\\s]", ""))) > 0
    assert sorted(map(repr, once.where(worded).collect())) == sorted(
        map(repr, twice.where(worded).collect()))


def test_sketch_rules_out_families_below_the_threshold():
    """Sets at the threshold pass, sets that share half don't."""
    import numpy as np
    import pyarrow as pa
    from veracity.llm import minhash as M
    r = np.random.default_rng(3)

    base = r.integers(0, 2 ** 63, 900).astype(np.uint64)
    near = [set(base[:800].tolist())]
    # 800 of 1000 in common: exactly 0.8
    near += [set(base[:800].tolist()) | set(r.integers(
        0, 2 ** 63, 200).tolist()) for _ in range(60)]
    half = [set(base[:300].tolist()) | set(r.integers(
        0, 2 ** 63, 300).tolist()) for _ in range(60)]
    sets = near + half

    class Frame:
        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays(
                [pa.array(range(len(sets))), pa.array([np.array(
                    sorted(s), np.uint64).tobytes() for s in sets],
                    pa.binary())], names=["id", "elements"])
            return next(iter(run(iter([batch]))))
    sk = np.array([np.unpackbits(np.frombuffer(x, np.uint8)) for x in
                   M._with_sketches(Frame(), MinHashParams()).column(2
                                                                     ).to_pylist()])
    most = M._most_bits(80)
    differ = (sk[0] != sk).sum(axis=1)
    assert (differ[:61] <= most).all()
    apart = (sk[61:, None] != sk[None, 61:]).sum(axis=2)
    assert (apart[np.triu_indices(60, 1)] > most).mean() > 0.99
