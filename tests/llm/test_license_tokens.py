"""License scans and token counts against plain versions."""

import random

import numpy as np
import pytest

from veracity.llm import licenses as L
from veracity.llm import tokencount as K

from . import cases


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(row[j], best[j + 1]))
        best = row
    return best[-1]


def test_alignment_counts_like_the_full_table():
    r = random.Random(6)
    for _ in range(200):
        t = [r.randrange(12) for _ in range(r.randrange(1, 12))]
        s = list(t)
        for _ in range(r.randrange(3)):
            k = r.randrange(len(s) + 1)
            s[k:k + r.randrange(2)] = [99] * r.randrange(2)
        pad = r.randrange(4)
        text = [50] * pad + s + [51] * 3
        n, first, last = L.align(np.array(t, np.uint64),
                                 np.array(text, np.uint64), pad, 6)
        assert n == lcs(t, text)
        if n:
            assert 0 <= first < last <= len(text)
            assert lcs(t, text[first:last]) == n
            assert text[first] in t and text[last - 1] in t


def test_notices_are_found_wherever_they_stand(spark):
    body = cases.words(1, 400)
    names = dict(L.TEMPLATES)
    rows, want = [], {}
    for k, (name, notice) in enumerate(L.TEMPLATES):
        at = (k * 37) % 400
        w = body[:at] + notice.split() + body[at:]
        rows.append((k, " ".join(w)))
        want[k] = (name, at)
    apache = names["Apache-2.0-header"].split()
    del apache[20:22]
    apache[40:40] = ["really"]
    rows += [(100, " ".join(body[:50] + apache + body[50:])),
             (101, " ".join(body)), (102, None), (103, ""),
             (104, "MIT License"), (105, "Released under the MIT License. x "
                                         "All rights reserved.")]
    df = spark.createDataFrame([(*r, 1) for r in rows],
                               "doc_id long, text string, license int")
    got = {r.doc_id: r for r in L.scan_licenses(df).collect()}
    assert len(got) == len(rows)
    for k, (name, at) in want.items():
        r = got[k]
        assert r.license == [name], (name, r)
        assert r.coverage == [1.0] and abs(r["first"][0] - at) <= 1
    assert got[100].license == ["Apache-2.0-header"]
    assert 0.9 < got[100].coverage[0] < 1
    assert [got[i].license for i in (101, 102, 103, 104)] == [[]] * 4
    assert got[105].license == ["MIT", "All-rights-reserved"]
    assert got[105]["first"] == [0, 6] and got[105]["last"] == [5, 9]
    rep = {r.doc_id: r for r in L.license_report(df).collect()}
    assert rep[105].best == "MIT" and rep[105].n_matches == 2
    assert rep[101].best is None and rep[101].licenses == ""


def _folder(tmp_path):
    """Two bodies of 600 and 2 000 words, a header, a short notice."""
    texts = {"Alpha-1.0.txt": cases.text(501, 600),
             "Beta-2.0.txt": cases.text(502, 2000),
             "Beta-2.0+header.txt": "This file is under the beta license, "
             "second version, whatever else is said of it elsewhere.",
             "Gamma.txt": "Licensed under Gamma 9."}
    folder = tmp_path / "templates"
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_text(text)
    return str(folder), {k.split(".txt")[0]: v for k, v in texts.items()}


def test_license_bodies_from_a_folder(spark, tmp_path):
    folder, texts = _folder(tmp_path)
    templates = L.read_templates(spark, folder)
    assert [n for n, _ in templates] == ["Alpha-1.0", "Beta-2.0", "Beta-2.0",
                                         "Gamma"]
    a, b = texts["Alpha-1.0"].split(), texts["Beta-2.0"].split()
    body = cases.words(3, 300)
    r = random.Random(5)
    edited = [x if r.random() > 0.06 else "changed" for x in b]
    edited[700:704] = []
    edited[1200:1200] = ["two", "more"]
    docs = {1: body[:100] + a + body[100:], 2: body + edited,
            3: a[:300] + body,                       # half of it: no
            4: a + ["between"] + a, 5: body,
            6: b + texts["Gamma"].split() + a,
            7: b[1000:] + b[:1000],                  # halves swapped: no
            8: texts["Beta-2.0+header"].split() + body}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()],
                               "doc_id long, text string")
    got = {x.doc_id: x for x in L.scan_licenses(
        df, templates=templates).collect()}
    names = {i: x.license for i, x in got.items()}
    assert names == {1: ["Alpha-1.0"], 2: ["Beta-2.0"], 3: [], 5: [], 7: [],
                     4: ["Alpha-1.0"] * 2, 8: ["Beta-2.0"],
                     6: ["Beta-2.0", "Gamma", "Alpha-1.0"]}
    assert (got[1]["first"], got[1]["last"]) == ([100], [700])
    assert got[1].coverage == [1.0] and got[1].matched == [600]
    assert 0.9 < got[2].coverage[0] < 0.96
    assert got[4]["first"] == [0, 601] and got[4]["last"] == [600, 1201]
    # matched words of a body are a common subsequence of text and body
    assert got[2].matched[0] <= lcs(b, body + edited)
    rep = L.license_report(df, templates=templates)
    assert rep.where("doc_id = 6").first().best == "Beta-2.0"


def test_a_brute_scan_finds_the_same_short_notices(spark):
    """Without index and winnowing: every template is aligned wherever one
    of its grams stands; what reaches the coverage there is reported, and
    nothing else is."""
    templates = [(n, t) for n, t in L.TEMPLATES if len(t.split()) < 16]
    r = random.Random(12)
    voc = sorted({w for _, t in templates for w in t.split()}) + ["x", "y"]
    rows = []
    for i in range(150):
        w = [r.choice(voc) for _ in range(r.randrange(30))]
        if i % 2:
            t = r.choice(templates)[1].split()
            if i % 3 == 0:
                t[r.randrange(len(t))] = "edit"
            w[len(w) // 2:len(w) // 2] = t
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = L.LicenseParams()
    got = {x.doc_id: set(x.license) for x in L.scan_licenses(
        df, p, templates).collect()}
    ix = L._index(templates, p)
    some = 0
    for i, text in rows:
        h = L._words(text.encode())
        want = set()
        for t, w in enumerate(ix.words):
            k = ix.widths[t]
            for d in {x - y for x in range(len(h) - k + 1)
                      for y in range(len(w) - k + 1)
                      if (h[x:x + k] == w[y:y + k]).all()}:
                lo, hi = max(0, d - p.band), min(len(h), d + len(w) + p.band)
                n, a, b = L.align(w, h[lo:hi], d - lo, p.band)
                if n and n >= p.coverage * len(w) and all(
                        L._stands(key, h[lo + a:lo + b])
                        for key in ix.keys[t]):
                    want.add(ix.names[t])
        assert got[i] <= want, (i, text)
        if len(want) == 1:
            assert got[i] == want, (i, text)
        some += bool(want)
    assert some > 60


def test_very_many_notices_and_a_very_long_word():
    import time
    ix = L._index(L.TEMPLATES, L.LicenseParams())
    notice = L._words(b"Released under the MIT License.")
    times = []
    for n in (5_000, 20_000):
        t0 = time.time()
        found = L._scan_text(ix, np.tile(notice, n), L.LicenseParams())
        times.append(time.time() - t0)
        assert len(found) == n
    assert times[1] < 12 * times[0]         # four times as many
    long = L._words(b"x" * 1_000_000 + b" all rights reserved")
    assert [x[2:4] for x in L._scan_text(ix, long, L.LicenseParams())
            ] == [(1, 4)]


def test_winnowing_keeps_a_place_of_every_window():
    g = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    for w in (1, 2, 4):
        kept = L._winnow(g, w)
        for i in range(len(g) - w + 1):
            assert any(i <= k < i + w for k in kept)
            assert g[i:i + w].min() in g[[k for k in kept if i <= k < i + w]]


def test_license_edge_rows(spark):
    df = cases.frame(spark)
    assert L.scan_licenses(df).count() == len(cases.rows())
    assert L.scan_licenses(cases.empty(spark)).count() == 0
    assert L.scan_licenses(df, templates=()).where(
        "size(license) > 0").count() == 0


def plain_counts(text, rule, enc, size):
    ids = enc.encode_ordinary(text)
    raw = text.encode()
    cuts, at = [], 0
    for line in raw.splitlines(keepends=True) if b"\r" not in raw else []:
        cuts.append((at, at + len(line)))
        at += len(line)
    count = [0.0] * len(cuts)
    pos = 0
    for i in ids:
        a, b = pos, pos + int(size[i])
        pos = b
        share = [max(0, min(b, y) - max(a, x)) for x, y in cuts]
        if rule == "start":
            count[next(k for k, s in enumerate(share) if s)] += 1
        elif rule == "most":
            count[share.index(max(share))] += 1
        else:
            for k, s in enumerate(share):
                count[k] += s / (b - a)
    return len(ids), count


@pytest.mark.parametrize("rule", K.RULES)
def test_sections_equal_a_plain_count(spark, rule):
    texts = ["a\n\n\nb", "no end", "é\U0001f600\n\n x\n", "\n\n\n\n", "a \n b",
             "one\ntwo  \n\n\n  three" * 20, cases.text(3, 200)]
    df = spark.createDataFrame(list(enumerate(texts)),
                               "doc_id long, text string")
    p = K.TokenParams(rule=rule)
    enc, size = K._encoder(p.vocabulary)
    crossed = 0
    for r in K.token_counts(df, p).collect():
        n, count = plain_counts(texts[r.doc_id], rule, enc, size)
        assert r.n_tokens == n
        assert np.allclose(r.tokens, count)
        assert abs(sum(r.tokens) - n) < 1e-6
        crossed += sum(r.crossing)
        lines = texts[r.doc_id].split("\n")
        begins = np.cumsum([0] + [len(x) + 1 for x in lines])
        assert r.begins == begins[:len(r.begins)].tolist()
    assert crossed > 0


def test_token_edge_rows(spark):
    df = cases.frame(spark)
    got = K.token_counts(df).collect()
    assert len(got) == len(cases.rows())
    assert all(not r.tokens for r in got if r.n_tokens == 0)
    t = K.section_table(df)
    assert t.where("section IS NULL").count() == 3
    assert K.section_table(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        K._count(K.TokenParams(rule="other"))


def test_every_single_edit_within_the_coverage_is_found():
    """Each template with one word missing, changed or added, in several
    surroundings, and twice in a row."""
    p = L.LicenseParams()
    ix = L._index(L.TEMPLATES, p)

    def names(text):
        return [ix.names[x[4]] for x in L._scan_text(
            ix, L._words(text.encode()), p)]
    for name, notice in L.TEMPLATES:
        w = notice.replace("-", " ").split()
        for k in range(len(w)):
            for edit in ([], ["other"], [w[k], "extra"]):
                text = w[:k] + edit + w[k + 1:]
                n = len(L._words(notice.encode()))
                gone = 0 if len(edit) == 2 else len(L._words(w[k].encode()))
                if n - gone < p.coverage * n:
                    continue
                for s in range(3):
                    around = cases.words(s, 20)
                    found = names(" ".join(around[:10] + text + around[10:]))
                    whole = all(L._stands(k, L._words(" ".join(text).encode()))
                                for k in ix.keys[ix.names.index(name)])
                    assert (name in found) == whole, text
        assert names(notice + " " + notice) == [name, name]


def test_relatives_keep_their_own_names():
    ix = L._index(L.TEMPLATES, L.LicenseParams())
    names = dict(L.TEMPLATES)
    gpl = names["GPL-3.0"]
    for text, want in [
            ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
            ("Licensed under CC BY-NC-ND 4.0", ["CC-BY-NC-ND-4.0"]),
            ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]),
            ("Licensed under the CC BY-NC 4.0", ["CC-BY-NC-4.0"]),
            ("Licensed under CC BY 3.0", []),
            (gpl, ["GPL-3.0"]), (gpl.replace("3", "2"), ["GPL-2.0"]),
            (gpl.replace("3", "9"), []),
            (gpl.replace("GNU", "GNU Lesser"), ["LGPL-3.0"]),
            (gpl.replace("GNU", "GNU Affero"), ["AGPL-3.0"]),
            (names["GPL-3.0-header"].replace("version 3", "version 2"),
             ["GPL-2.0-header"]),
            ("Released under the BSD License.", [])]:
        got = L._scan_text(ix, L._words(text.encode()), L.LicenseParams())
        assert [ix.names[x[4]] for x in got] == want, text
