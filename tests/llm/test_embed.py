"""Embedding near-duplicates against brute force, and recall."""

import math

import numpy as np

from veracity.llm.embed import EmbedParams, link_vectors, near_pairs, passes_for


def brute(vectors, cosine):
    ids = list(vectors)
    unit = {}
    for i in ids:
        v = vectors[i]
        if v is None or not len(v) or any(
                x is None or not math.isfinite(x) for x in v):
            continue
        n = np.linalg.norm(v)
        if n > 0:
            unit[i] = np.array(v) / n
    root = {i: i for i in ids}
    links = dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    u = sorted(unit)
    for k, a in enumerate(u):
        for b in u[k + 1:]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (links[i], find(i)) for i in ids}


def sample(n, seed, dim=16):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim))
    rows = {}
    for i in range(n):
        rows[i] = base[i].astype(np.float32).astype(float).tolist()
        if i % 5 == 0:
            rows[n + i] = (base[i] + 0.2 * r.standard_normal(dim)).tolist()
        if i % 7 == 0:
            rows[2 * n + i] = list(rows[i])
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, v, 0, 1) for i, v in rows.items()],
        "vec_id long, embedding array<double>, digest int, id int")


def test_links_equal_brute_force_with_edge_rows(spark):
    rows = sample(150, 1)
    rows |= {9000: None, 9001: [], 9002: [0.0] * 16, 9003: [1.0, None],
             9004: [float("nan")] * 16, 9005: [float("inf")] * 16,
             9006: [2.0], 9007: [3.0], 9008: [1e300, 1e300],
             9009: [1e-300, 1e-300]}
    want = brute({k: v for k, v in rows.items() if k < 9008}, 0.9)
    want |= {9008: (1, 9008), 9009: (1, 9008)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(
        frame(spark, rows)).collect()}
    assert got == want


def test_no_rows_and_no_ids(spark):
    df = frame(spark, {1: [1.0, 0.0]})
    assert link_vectors(df.limit(0)).count() == 0
    two = spark.createDataFrame(
        [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])],
        "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.component_id or 0, r.kept)
                 for r in link_vectors(two).collect())
    assert got == [(0, 0, True), (3, 3, True), (3, 3, True)]


def test_recall_with_small_windows(spark):
    """Many more vectors than a window: the passes must find the pairs."""
    rows = sample(3000, 2, dim=32)
    keep = {i: v for i, v in rows.items() if i < 6000}
    m = np.array(list(keep.values()))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.array(list(keep))
    a, b = np.nonzero(np.triu(m @ m.T >= 0.9, 1))
    true = {tuple(sorted((int(ids[x]), int(ids[y])))) for x, y in zip(a, b)}
    p = EmbedParams(window=32)
    assert passes_for(len(keep), p) > 8
    df = spark.createDataFrame(
        [(int(i), v.tobytes(), True) for i, v in zip(ids, m)],
        "id long, raw binary, wide boolean")
    found = {(r.a, r.b) for r in near_pairs(df, p).collect()}
    assert found <= true
    assert len(found) >= 0.97 * len(true) and len(true) > 400


def test_a_cluster_of_many_windows_loses_no_link(spark):
    """700 different vectors, all near each other, under a window of 8 and
    among others: counts and components equal brute force."""
    r = np.random.default_rng(7)
    centre = r.standard_normal(24)
    rows = {i: (centre + 0.1 * r.standard_normal(24)).tolist()
            for i in range(700)}
    rows |= {1000 + i: r.standard_normal(24).tolist() for i in range(700)}
    rows |= {2000: list(rows[0]), 2001: list(rows[0])}
    want = brute(rows, 0.9)
    assert min(want[i][0] for i in range(700)) > 600
    got = {x.vec_id: (x.n_links, x.component_id) for x in link_vectors(
        frame(spark, rows), EmbedParams(window=8)).collect()}
    assert got == want


def test_repeated_ids(spark):
    """A repeated row is one vector; an id with two vectors joins their
    components; equal vectors of other ids are links."""
    a, near_a, b = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 1.0, 0.0]
    lone = [0.0, 0.0, 1.0]
    rows = [(7, a), (7, a), (8, near_a), (9, a), (9, b), (10, b), (12, lone),
            (12, lone), (13, [0.0, -1.0, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept)
                 for r in link_vectors(df).collect())
    assert got == [(7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False),
                   (9, 1, 7, False), (9, 2, 7, False), (10, 1, 7, False),
                   (12, 0, 12, True), (12, 0, 12, True), (13, 0, 13, True)]


def test_windows_reach_over_the_borders_of_parts(spark):
    """Neighbours in the order that share no leading bits are found by the
    window, and counted once."""
    from veracity.llm import embed as E
    p = EmbedParams(window=16)
    rows = sample(1500, 9, dim=12)
    got = {r.vec_id: r.n_links for r in link_vectors(
        frame(spark, rows), p).collect()}
    want = {i: n for i, (n, _) in brute(rows, 0.9).items()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.98 * sum(want.values()) > 400
    n = len({tuple(v) for v in rows.values()})
    bits = E.leading_bits(n, p)
    assert bits > E.DEAL_BITS


def test_first_look_ships_no_vectors(spark):
    from veracity.llm import embed as E
    look = spark.createDataFrame(
        [(1, 2, b"s", 0, 5)], "id long, dim int, sketch binary, pass int, "
        "code long")
    dealt = E._dealt(look, 40, EmbedParams(), ["sketch"])
    assert dealt.columns == ["pass", "dim", "part", "u", "v", "side", "id",
                             "code", "sketch"]


def test_sketch_limit_keeps_pairs_at_the_threshold():
    from veracity.llm.embed import sketch_limit
    r = np.random.default_rng(1)
    a = r.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = r.standard_normal((4000, 32))
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.9 * a + math.sqrt(1 - 0.81) * o
    planes = r.standard_normal((32, 128))
    differ = ((a @ planes > 0) != (b @ planes > 0)).sum(axis=1)
    assert differ.max() <= sketch_limit(EmbedParams())
