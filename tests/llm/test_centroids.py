"""Bit-plane arithmetic and clustering against plain integers."""

import hashlib

import numpy as np
import pytest

from veracity.llm import centroids as K

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def brute(rows, k, rounds, scale=256, seed=2):
    """(id, vector, cluster, distance) lists by Python integers."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64
            and all(x is not None and np.isfinite(x) for x in v)]

    def key(t):
        return (t[0] is None, hashlib.sha256(
            f"{seed}:{t[0]}".encode()).hexdigest())
    c = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def assign(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c]
        return min(range(len(c)), key=lambda j: (d[j], j)), min(d)
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[0], []).append(v)
        for j, vs in groups.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return [(i, *assign(v)) for i, v in kept], c


@pytest.mark.parametrize("bits", [1, 2, 9, 20, 28])
def test_planes_are_exact(bits):
    r = np.random.default_rng(bits)
    lo, hi = -(1 << (bits - 1)), (1 << (bits - 1))
    x = r.integers(lo, hi, (50, 64))
    x[0], x[1] = lo, hi - 1
    c = r.integers(-300, 300, (7, 64))
    assert K.bits_needed(x).max() <= bits
    px, pc = K.pack_planes(x, bits), K.pack_planes(c, 10)
    assert (K.unpack_planes(px) == x).all()
    assert (K.dot_planes(px, pc) == x @ c.T).all()
    cluster, dist = K.nearest(px, pc, (c * c).sum(axis=1))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all()
    assert (dist == d.min(axis=1)).all()


def _vectors():
    r = np.random.default_rng(5)
    base = r.normal(size=(6, 64)) * 0.3
    rows = [(i, (base[i % 6] + 0.05 * r.normal(size=64)).tolist())
            for i in range(300)]
    rows += [(1000 + i, base[0].tolist()) for i in range(150)]   # copies
    rows += [(1, rows[1][1]), (1, rows[2][1])]          # a repeated id
    rows += [(None, base[1].tolist()), (2000, (base[2] * 40).tolist())]
    bad = base[0].tolist()
    return rows + [
        (3000, None), (3001, []), (3002, bad[:63]), (3003, bad + [0.0]),
        (3004, [None] + bad[1:]), (3005, [float("nan")] + bad[1:]),
        (3006, [float("inf")] + bad[1:])]


@pytest.mark.parametrize("k,rounds", [(8, 5), (40, 2), (1, 1)])
def test_clusters_equal_plain_integers(spark, k, rounds):
    rows = _vectors()
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    want, centroids = brute(rows, k, rounds)
    got = K.cluster_vectors(df.repartition(7), K.CentroidParams(
        k=k, rounds=rounds)).collect()
    def order(t):
        return (t[0] is None, t[0] or 0, *t[1:])
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got],
                  key=order) == sorted(want, key=order)
    total = sum(d for _, _, d in want)
    for r in got:
        assert r["inertia"] == total
        assert r["cluster_inertia"] == sum(
            d for _, c, d in want if c == r["cluster"])
        assert r["centroid"] == centroids[r["cluster"]]


def test_no_or_few_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert K.cluster_vectors(empty).count() == 0
    none = spark.createDataFrame([(1, None, 0, ""), (2, [0.5], 0, "")],
                                 SCHEMA)
    assert K.cluster_vectors(none).count() == 0
    two = spark.createDataFrame(
        [(5, [0.1] * 64, 0, ""), (6, [-0.1] * 64, 0, "")], SCHEMA)
    got = K.cluster_vectors(two).collect()
    assert sorted(r["cluster"] for r in got) == [0, 1]
    assert {r["inertia"] for r in got} == {0}


def test_too_wide_component_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] + [0.0] * 63, 0, "")], SCHEMA)
    with pytest.raises(Exception, match="28 bits"):
        K.cluster_vectors(df).collect()
