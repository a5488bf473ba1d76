"""Restoration, learning and held-out accuracy of the toxicity scores."""

import random
import zlib

import numpy as np

from veracity.llm import toxicity as T

from . import cases

BAD = ["idiot", "moron", "scumbag"]
OBFUSCATED = {"idiot": ["1d10t", "i.d.i.o.t", "idiooot", "i d i o t"],
              "moron": ["m0r0n", "m-o-r-o-n", "moronnn", "m o r o n"],
              "scumbag": ["$cumbag", "sc.um.bag", "scuuumbag", "scumb@g"]}


def corpus(n=600):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        w = cases.words(i, r.randrange(20, 60))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((i, " ".join(w).replace("0 ", " "), "en"))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return (spark.createDataFrame(rows, "doc_id long, text string, "
                                  "score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, "
                                  "toxic int"))


def test_held_out_documents_and_obfuscated_words(spark):
    rows, labels = corpus()
    hidden = []
    for k, (plain, forms) in enumerate(sorted(OBFUSCATED.items())):
        for j, f in enumerate(forms):
            hidden.append((5000 + 10 * k + j,
                           f"{cases.text(k, 15)} you {f} {cases.text(j, 9)}",
                           "en"))
    docs, y = frames(spark, rows + hidden, labels)
    got = {r.doc_id: r for r in T.toxicity(docs, y).collect()}
    assert len(got) == len(rows) + len(hidden)
    truth = {i: t for i, _, t in labels}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if i in truth:
            assert r.predicted == truth[i], i
    caught = [i for i, *_ in hidden if got[i].predicted]
    assert len(caught) >= 11


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows, labels = corpus(150)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t)
            for i, q, t in labels]
    docs, y = frames(spark, rows, labels)
    _, z = frames(spark, rows, flip)
    a = sorted((r.doc_id, r.score) for r in T.toxicity(docs, y).collect())
    b = sorted((r.doc_id, r.score) for r in T.toxicity(docs, z).collect())
    assert a == b


def test_edge_rows_and_no_labels(spark):
    df = cases.frame(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.toxicity(df, none).collect()
    assert len(got) == len(cases.rows())
    assert not any(r.predicted for r in got)
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (3, 1)],
                                "doc_id long, toxic int")
    assert T.toxicity(df, odd).count() == len(cases.rows())
    assert T.toxicity(cases.empty(spark), none).count() == 0
    assert T.reject_toxic(df, none).columns == df.columns


def all_paths(span, model, p):
    """Cheapest cost of each text that the lattice of a span can read."""
    paths = [("", 0.0)]
    before = ""
    for ch in span:
        options = [(ch, 0.0)] if ch.isalpha() else [
            (" ", p.symbol_cost if ch in T.LEET else 0.0),
            *[(x, p.leet_cost) for x in T.LEET.get(ch, "")],
            *([("", p.space_cost)] if ch in T.SEPARATORS else [])]
        if ch == before:
            options.append(("", p.repeat_cost))
        paths = [(t + x, c + k) for t, c in paths for x, k in options]
        before = ch
    best = {}
    for t, c in paths:
        a = b = 0
        for x in t:
            k = T._class(x)
            c -= model[a][b][k]
            a, b = b, k
        c -= model[a][b][0]
        best[t] = min(c, best.get(t, c))
    return best


def test_viterbi_finds_the_cheapest_path():
    r = np.random.default_rng(5)
    model = r.normal(-2, 1, (28, 28, 28))
    p = T.ToxicityParams()
    for span in ["1d10t", "a  b", "sss!", "m.o.r", "x11|", "tttt", "é3é3"]:
        best = all_paths(span, model, p)
        got = T.restore(span, model.tolist(), p)
        assert abs(best[got] - min(best.values())) < 1e-9


COMBINED = {"idiot": ["1d10t", "i.d.i.o.t", "idiooot", "i d i o t", "idiiot",
                      "iddiioott", "i d 1 0 t", "i.d.1.0.t", "i--d--i--o--t",
                      "id.i.ot", "i - d - i - o - t", "1dii00t", "i_d_!_0_t"],
            "moron": ["m0r0n", "m-o-r-o-n", "moronnn", "m o r o n", "moroon",
                      "mmoorroonn", "m 0 r 0 n", "m.0.r.0.n",
                      "m--o--r--o--n", "mo.ro.n", "m00r0n"],
            "scumbag": ["$cumbag", "sc.um.bag", "scuuumbag", "scumb@g",
                        "scummbagg", "s c u m b @ g", "$.c.u.m.b.4.g",
                        "s**c**u**m**b**a**g", "$cu.mb4g"]}


def test_every_form_of_an_obfuscated_word_is_found(spark):
    rows, labels = corpus()
    hidden = {}
    for k, (_, forms) in enumerate(sorted(COMBINED.items())):
        for j, f in enumerate(forms):
            hidden[5000 + 100 * k + j] = (
                f"{cases.text(k, 15)} you {f} {cases.text(j, 9)}", f)
    docs, y = frames(spark, rows + [(i, t, "en") for i, (t, _) in
                                    hidden.items()], labels)
    got = {r.doc_id: r for r in T.toxicity(docs, y).collect()}
    assert [f for i, (_, f) in hidden.items() if not got[i].predicted] == []
    truth = {i: t for i, _, t in labels}
    assert all(got[i].predicted == t for i, t in truth.items())


def test_numbers_alone_are_no_words():
    reader = T.Reader(np.zeros((28, 28, 28)).tolist(), T.ToxicityParams())
    assert reader.spaced(["1", "0", "5", "-"]) == ()
    assert reader.plain("2.400") == "2.400"
    assert T._single("!") == "!" and T._single("--") == ""


def test_a_word_of_a_million_letters():
    """The work grows with the length: no path is copied."""
    import time
    model, p = np.full((28, 28, 28), -3.0).tolist(), T.ToxicityParams()
    times = []
    for n in (20_000, 200_000):
        t0 = time.time()
        out = T.restore("ab" * n, model, p)
        times.append(time.time() - t0)
        assert out == "ab" * n
    assert times[1] < 25 * times[0]         # ten times as long
    assert T.restore("1" + "x" * 1_000_000, model, p)


def test_all_features_that_pass_are_candidates(spark):
    """No cap on the list that the lexicon is chosen from."""
    assert "candidates" not in T.ToxicityParams.__dataclass_fields__
