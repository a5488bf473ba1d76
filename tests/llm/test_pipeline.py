"""The pipeline on a small fixture, each stage against plain Python."""

import random
from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest

import __spark_entry__ as entry

from . import cases
from .test_decontam import brute as brute_hits
from .test_minhash import brute as brute_groups
from .test_minhash import variants

BAD = ["idiot", "moron"]


def fixture():
    r = random.Random(8)
    docs, labels, bench = [], [], []
    bench = [(i, cases.text(900 + i, 30)) for i in range(5)]
    texts = []
    for i in range(260):
        w = cases.words(i, r.randrange(25, 70))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        texts.append((" ".join(w), int(toxic)))
    texts += [(t, 0) for t in variants(77, 30, 60, 4)]
    texts += [(cases.text(5, 40), 0)] * 3
    texts += [("before " + bench[2][1] + " after", 0),
              (cases.text(6, 900) + " " + bench[3][1], 0)]
    texts += [(None, 0), ("", 0), ("short", 0)]
    for i, (t, y) in enumerate(texts):
        source = [None, "a", "b", "c", "a", "a"][i % 6]
        docs.append((i, t, "en", source, len(t or "")))
        if i % 3:
            labels.append((i, 1, y))
    return docs, labels, bench, {i: y for i, (_, y) in enumerate(texts)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    docs, labels, bench, truth = fixture()
    for name, rows, schema in (
            ("documents", docs, "doc_id long, text string, lang string, "
             "source string, n_chars long"),
            ("labels", labels, "doc_id long, quality int, toxic int"),
            ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(
            f"{root}/{name}.parquet")
    return root, docs, bench, truth


def test_stages(spark, tables):
    root, docs, bench, truth = tables
    frame = spark.read.parquet(f"{root}/documents.parquet")
    columns = frame.columns
    before = {r.doc_id: r for r in frame.collect()}
    out = {}
    for name, stage in P.STAGES:
        frame = P.common.save(stage(spark, frame, root), name)
        out[name] = frame.collect()
        if name != P.STAGES[-1][0]:
            assert frame.columns == columns
            assert all(r == before[r.doc_id] for r in out[name])
    kept = {r.doc_id for r in out["toxicity"]}
    assert kept == {i for i, y in truth.items() if not y}

    groups = brute_groups([(i, before[i].text) for i in kept], 5)
    kept = {i for i, (_, c) in groups.items() if i == c}
    assert sorted(r.doc_id for r in out["near_dedup"]) == sorted(kept)

    hits = brute_hits([(i, before[i].text) for i in kept], bench)
    kept = {i for i in kept if not hits[i][4]}
    assert sorted(r.doc_id for r in out["decontamination"]) == sorted(kept)
    assert 0 < len(kept) < len(docs)

    taken = Counter(r.doc_id for r in out["mixing"])
    assert set(taken) <= kept and max(taken.values()) == 2

    rows = out["sharding"]
    assert Counter(r.doc_id for r in rows) == taken
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_and_registration(spark, tables):
    root = tables[0]
    got = P.run(spark, root)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"
            } == set(got.columns)
    assert got.count() > 100
    q, o = entry.queries(), entry.oracle_sql()
    names = [n for n in q if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(
        range(1, 14))
    assert q["pipeline"] is P.run and set(o) <= set(q)


def test_empty_documents(spark, tables, tmp_path):
    root = tables[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(
            f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_verdicts_reach_only_their_own_rows(spark, tables):
    """Clean, toxic and contaminated rows that have a null or the same id."""
    root, _, bench, _ = tables
    frame = spark.read.parquet(f"{root}/documents.parquet")
    clean, toxic = cases.text(41, 40), cases.text(42, 30) + " idiot moron"
    hit = "before " + bench[1][1] + " after"
    more = [(i, t, "en", "a", 0) for i in (None, 7000)
            for t in (clean, toxic, hit, None)]
    extra = spark.createDataFrame(more, frame.schema)
    got = P.reject_toxic(spark, frame.union(extra), root).where(
        "doc_id IS NULL OR doc_id = 7000").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(
        (i, t) for i, t, *_ in more if t != toxic)
    got = P.drop_contaminated(spark, extra, root).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(
        (i, t) for i, t, *_ in more if t != hit)
