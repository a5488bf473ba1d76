"""Mixing and sharding against their rules."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veracity.llm import common
from veracity.llm.mixing import mix, plan_mix, position
from veracity.llm.sharding import ShardParams, shard, shard_table, write_shards

from . import cases


def expected_targets(size, weights=(3, 1, 2)):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget = 1.5 * sum(size.values())
    capped = set()
    while True:
        left = budget - sum(2 * size[s] for s in capped)
        rest = sum(w[s] for s in w if s not in capped)
        target = {s: 2 * size[s] if s in capped else w[s] * left / rest
                  for s in w}
        over = {s for s in w if s not in capped and target[s] >= 2 * size[s]}
        if not over:
            return target
        capped |= over


def test_targets_and_taken_words(spark):
    df = cases.frame(spark)
    got = plan_mix(df).collect()
    assert len(got) == len(cases.rows())
    size = defaultdict(int)
    for _, t, _, s, *_ in cases.rows():
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = expected_targets(size)
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6
        assert r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.5
    again = plan_mix(df.repartition(5)).collect()
    key = lambda r: (r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_rows_follow_the_plan(spark):
    df = cases.frame(spark)
    plan = Counter()
    for r in plan_mix(df).collect():
        if r.size:
            plan[r.doc_id] += -(-r.taken // r.size)
    out = mix(df).collect()
    assert Counter(r.doc_id for r in out) == +plan
    at = [r["__position"] for r in out]
    assert at == sorted(at) and all(0 <= t <= 1 for t in at)
    assert mix(df).columns == [*df.columns, "__position"]
    assert mix(cases.empty(spark)).count() == 0


def test_rows_that_repeat_id_and_text(spark):
    """Half of a source is one document, in rows that differ elsewhere and
    rows that don't; the same id and text lie in two sources.  Every row is
    taken as often as its place says, and reruns agree."""
    hot = cases.text(5, 12)
    rows = [(7, hot, "a", i % 40) for i in range(300)]
    rows += [(7, hot, "b", 5)] * 3 + [(None, hot, "a", 1)] * 4
    rows += [(100 + i, cases.text(i, 10 + i % 5), "ab"[i % 2], i)
             for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, "
                               "source string, n_chars long")
    plan = Counter()
    for r in plan_mix(df).collect():
        plan[r.doc_id, r.source] += -(-r.taken // r.size)
    out = mix(df).collect()
    assert Counter((r.doc_id, r.source) for r in out) == +plan
    of_rows = Counter(rows)
    for row, n in Counter((r.doc_id, r.text, r.source, r.n_chars)
                          for r in out).items():
        assert n <= 2 * of_rows[row]
    again = mix(df.repartition(7)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    at = {r["__position"] for r in out if r.doc_id == 7 and r.source == "a"}
    assert len(at) > 250


def test_unfold_counts_every_number(spark):
    df = spark.createDataFrame([(1, 5, 9), (2, 1, 350), (3, 7, 6 + 100)],
                               "k int, a long, b long")
    got = common.unfold(df, F.col("a"), F.col("b"), "n", stretch=100)
    assert got.columns == ["k", "a", "b", "n"]
    assert sorted((r.k, r.n) for r in got.collect()) == sorted(
        [(1, n) for n in range(5, 10)] + [(2, n) for n in range(1, 351)]
        + [(3, n) for n in range(7, 107)])


def test_position_inverts_the_integral(spark):
    knots = ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5))

    def integral(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            d = min(max(t - t0, 0), t1 - t0)
            total += w0 * d + (w1 - w0) / (t1 - t0) * d * d / 2
        return total
    rows = spark.range(101).select((F.col("id") / 100).alias("x"))
    for r in rows.select("x", position(F.col("x"), knots).alias("t")
                         ).collect():
        assert abs(integral(r.t) / integral(1.0) - r.x) < 1e-9
    flat = ((0.0, 0.0), (1.0, 2.0))
    r = spark.range(1).select(position(F.lit(0.25), flat).alias("t")).first()
    assert abs(r.t - 0.5) < 1e-9


def test_shards(spark):
    rows = [(i, cases.text(i, i % 50), "en", "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, "
                               "source string")
    got = shard_table(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    slots = defaultdict(list)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        slots[r.shard].append((r.slot, r.doc_id))
        assert r.grown_shard in (r.shard, 16)
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    assert set(slots) == set(range(16))
    for s in slots.values():
        assert sorted(x for x, _ in s) == list(range(len(s)))
        ids = [i for _, i in sorted(s)]
        assert ids != sorted(ids)
    n = Counter(r.shard for r in got)
    assert max(n.values()) < 1.5 * min(n.values())
    moved = sum(r.grown_shard == 16 for r in got)
    assert 100 < moved < 260
    again = {(r.doc_id, r.shard, r.slot) for r in shard_table(
        df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_many_equal_rows_fill_several_buckets(spark, tmp_path):
    rows = [(i, "t") for i in range(300)] + [(7, "copy")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "s")
    write_shards(df, path, ShardParams(shards=2, bucket_rows=50))
    sizes = spark.read.parquet(path).groupBy("__shard", "__bucket").count()
    assert sizes.agg(F.max("count")).first()[0] < 300
    t = shard_table(df, ShardParams(shards=2, bucket_rows=50)).collect()
    assert len(t) == len(rows)
    assert len({r.shard for r in t if r.doc_id == 7 and r.size == 5}) == 1
    for s in (0, 1):
        slots = sorted(r.slot for r in t if r.shard == s)
        assert slots == list(range(len(slots)))


def test_fisher_yates_is_uniform(spark):
    from veracity.llm.sharding import fisher_yates
    rows = spark.range(6000).select(
        fisher_yates(F.lit(3), F.col("id"), 1).alias("p")).collect()
    n = Counter(tuple(r.p) for r in rows)
    assert len(n) == 6 and all(800 < c < 1200 for c in n.values())
    assert spark.range(1).select(fisher_yates(F.lit(1), F.col("id"), 1)
                                 .alias("p")).first().p == [0]


def test_shard_edge_rows(spark, tmp_path):
    df = cases.frame(spark)
    out = shard(df, ShardParams(shards=3))
    assert out.count() == len(cases.rows())
    assert set(df.columns) < set(out.columns)
    t = shard_table(df).collect()
    assert sum(r.size for r in t) == sum(
        len((x[1] or "").encode()) + 1 for x in cases.rows())
    assert shard_table(cases.empty(spark)).count() == 0
    write_shards(df, str(tmp_path / "s"), ShardParams(shards=2))
    assert {p.name for p in (tmp_path / "s").glob("__shard=*")} <= {
        "__shard=0", "__shard=1"}


# --- the whole op3 table by plain Python --------------------------------------

def _hash(*values):
    """Spark's xxhash64 of (value, bytes) columns: each is hashed with the
    hash of those before as its seed, nulls are passed over."""
    import xxhash
    h = 42
    for v, size in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(
                (v % 2 ** (8 * size)).to_bytes(size, "little"), seed=h)
    return h - 2 ** 64 if h >= 2 ** 63 else h


def _plain_shard(key, shards, seed):
    return -max((_hash((seed, 4), (key, 8), (s, 4)), -s)
                for s in range(shards))[1]


def _plain_shards(rows, p):
    """(doc_id, size, crc, shard, slot, grown) of all rows (id, text)."""
    n, total = len(rows), sum(len((t or "").encode()) for _, t in rows)
    per_shard = max(1, -(-n // (p.bucket_rows * p.shards)),
                    -(-total // (p.bucket_bytes * p.shards)))
    buckets = defaultdict(list)
    for key, text in rows:
        crc = None if text is None else zlib.crc32(text.encode())
        shard = _plain_shard(key, p.shards, p.seed)
        sub = _hash((p.seed + 1, 4), (key, 8), (crc, 8), (0, 8)) % per_shard
        buckets[shard, sub].append((_hash((p.seed + 2, 4), (key, 8),
                                          (crc, 8)), key, text, crc))
    slot, out = Counter(), []
    for (shard, sub), items in sorted(buckets.items()):
        items.sort(key=lambda x: x[0])
        perm = list(range(len(items)))
        name = _hash((shard, 4), (sub, 8))
        for i in range(len(items) - 1, 0, -1):
            j = _hash((p.seed + 3, 4), (name, 8), (i, 4)) % (i + 1)
            perm[i], perm[j] = perm[j], perm[i]
        for at in perm:
            _, key, text, crc = items[at]
            out.append((key, len((text or "").encode()) + 1, crc or 0, shard,
                        slot[shard], _plain_shard(key, p.shards + 1, p.seed)))
            slot[shard] += 1
    return out


@pytest.mark.parametrize("p", [ShardParams(), ShardParams(
    shards=3, bucket_rows=20, seed=9), ShardParams(shards=2,
                                                   bucket_bytes=3000)])
def test_shard_table_equals_plain_python(spark, p):
    rows = [(i, cases.text(i, i % 30)) for i in range(700)]
    rows += [(None, "no id"), (2000, None), (2001, ""), (2002, "é" * 50),
             (-5, "below zero"), (2 ** 40, "far")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.grown_shard)
           for r in shard_table(df.repartition(5), p).collect()]
    assert sorted(got, key=repr) == sorted(_plain_shards(rows, p), key=repr)
