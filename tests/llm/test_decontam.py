"""Positional index against brute force over words."""

import hashlib
import math
import random
import re

from veracity.llm.decontam import (DecontamParams, build_index, contamination,
                                   decontaminate, item_blocks, search)

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=13):
    out = {}
    wins = []
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        if n:
            wins += [(str(i), w[k:k + n]) for k in range(len(w) - n + 1)]
    for d, t in docs:
        w = words(t)
        hit, names = set(), set()
        for name, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k:k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    names.add(name)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(names), sha,
                  bool(hit) and 20 * len(hit) >= len(w))
    return out


def tables():
    r = random.Random(4)
    vocabulary = ["w" + str(i) for i in range(30)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(
        r.choice([1, 2, 5, 13, 14, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "Écoute, élan!"), (103, items[3][1])]
    docs = []
    for i in range(120):
        w = [r.choice(vocabulary) + r.choice(["", "", "x"])
             for _ in range(r.randrange(60))]
        if i % 4 == 0:
            w[len(w) // 2:len(w) // 2] = words(r.choice(items)[1])
        docs.append((i, r.choice([" ", "\n", ", "]).join(w)))
    docs += [(500, None), (501, ""), (502, "ÉCOUTE élan"), (503, "Écoute élan")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, 1) for d in docs],
                                  "doc_id long, text string, n_words int"),
            spark.createDataFrame([(*i, 2) for i in items],
                                  "item_id long, text string, doc_id int"))


def test_equal_to_brute_force(spark):
    docs, items = tables()
    want = brute(docs, items)
    d, b = frames(spark, docs, items)
    for p in (DecontamParams(), DecontamParams(segment_bytes=300),
              DecontamParams(block_words=40)):
        got = {r.doc_id: tuple(r)[1:] for r in contamination(d, b, p)
               .collect()}
        assert got == want
    kept = {r.doc_id for r in decontaminate(d, b).collect()}
    assert kept == {i for i, x in want.items() if not x[4]}


def test_proximity_matches(spark):
    item = " ".join(f"q{i}" for i in range(13))
    loose = item.replace("q6", "zzz q6").replace("q3 ", "")
    far = " ".join(x + " a b c d e" for x in item.split())
    d, b = frames(spark, [(1, "start " + item + " end"), (2, loose), (3, far)],
                  [(7, item)])
    p = DecontamParams(slop=2)
    got = {r.doc_id: list(zip(r["items"], r.kinds, r["first"], r["last"]))
           for r in search(build_index(d, p), b, p).collect()}
    assert ("7", "phrase", 1, 14) in got[1]
    assert any(x[1] == "proximity" for x in got[1])
    assert [x[1] for x in got[2]] and {x[1] for x in got[2]} == {"proximity"}
    assert got[3] == []


def brute_near(docs, items, slop, share, width=13):
    """(words in proximity matches, items) by trying every start."""
    wins = [(str(i), w[k:k + width]) for i, t in items if (w := words(t))
            for k in range(max(1, len(w) - width + 1))]
    out = {}
    for d, t in docs:
        w = words(t)
        at = {}
        for j, x in enumerate(w):
            at.setdefault(x, set()).add(j)
        hit, names = set(), set()
        for name, win in wins:
            need = math.ceil(share * len(win) - 1e-9)
            for s in range(-width - slop, len(w) + slop + 1):
                n = sum(any(s + k + e in at.get(x, ())
                            for e in range(-slop, slop + 1))
                        for k, x in enumerate(win))
                if n >= need:
                    names.add(name)
                    hit.update(range(max(0, s), min(len(w), s + len(win))))
        out[d] = (len(hit), len(names))
    return out


def test_proximity_equals_trying_every_start(spark):
    r = random.Random(11)
    vocabulary = ["w" + str(i) for i in range(25)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n)))
             for i, n in enumerate((1, 2, 6, 13, 13, 15, 20))]
    docs = []
    for i in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randrange(25))]
        if i % 2:
            part = words(r.choice(items)[1])
            for _ in range(r.randrange(4)):
                k = r.randrange(len(part) + 1)
                part[k:k + r.randrange(2)] = ["zz"] * r.randrange(2)
            w[len(w) // 2:len(w) // 2] = part
            w = w[r.randrange(3):]
        docs.append((i, " ".join(w)))
    d, b = frames(spark, docs, items)
    want = brute_near(docs, items, 2, 0.8)
    assert sum(x[1] for x in want.values()) > 60
    for p in (DecontamParams(slop=2), DecontamParams(
            slop=2, segment_bytes=200, block_words=26)):
        got = {x.doc_id: (x.n_near_hit, x.n_near_items)
               for x in contamination(d, b, p).collect()}
        assert got == want


def test_a_test_set_beyond_the_broadcast_is_joined(spark):
    """Blocks and segments meet in a join; long items lie in several
    blocks, documents without a match still have their row."""
    docs, items = tables()
    items.append((300, " ".join(f"w{i % 30}" for i in range(400))))
    docs.append((900, " ".join(f"w{i % 30}" for i in range(100, 180))))
    want = brute(docs, items)
    d, b = frames(spark, docs, items)
    p = DecontamParams(block_words=30, broadcast_bytes=0, segment_bytes=500)
    assert item_blocks(b, p).count() > 12
    got = {r.doc_id: tuple(r)[1:] for r in contamination(d, b, p).collect()}
    assert got == want


def test_edge_rows(spark):
    df = cases.frame(spark)
    bench = spark.createDataFrame([(1, cases.BASE), (None, "café été")],
                                  "item_id long, text string")
    got = contamination(df, bench).collect()
    assert len(got) == len(cases.rows())
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[1].contaminated and by[3].contaminated
    assert not by[9].contaminated and by[4].n_words == 0
    assert not by[12].contaminated and by[12].n_hit == 0
    assert contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert contamination(cases.empty(spark), bench).count() == 0
    assert decontaminate(df, bench).columns == df.columns
