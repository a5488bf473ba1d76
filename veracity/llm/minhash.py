"""MinHash near-duplicates with tensored banding.

``m`` small collections of ``r`` minhashes are computed per document; the
key of a table combines the values of two collections, so ``m * r`` hash
functions serve ``m * (m - 1) / 2`` tables of ``2 * r`` hashes each (16
collections of 3: 48 functions for 120 tables instead of 720).  Two sets
meet in a table when two collections agree, so a pair of similarity s is
missed with probability (1 - p)^m + m p (1 - p)^(m - 1), p = s^r: 1.8e-4
at 0.8, 7e-6 at 0.85, below 1e-8 at 0.9.

Every candidate is confirmed on the full shingle sets.  Equal sets are
first reduced to one representative (128-bit sums of the shingles).  Each
set is then compared with one other, the hub of a bucket that it shares
most tables with, unless sizes or sketches (two bits of each minhash) rule
the pair out; that links nearly all copies without listing pairs.  What is
left in different components although it shares a bucket is compared
exactly, in blocks, so a bucket costs comparisons only for the sets that
its largest component does not hold; a sketch of 512 bits rules out most of
those below the threshold beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = C.U64


@dataclass(frozen=True)
class MinHashParams:
    """``percent``: link sets with 100 * |A and B| >= percent * |A or B|."""

    shingle: int = 5
    percent: int = 80
    collections: int = 16
    per_collection: int = 3
    seed: int = 7
    block_bytes: int = 2 << 20
    salts: int = 32


SET_SCHEMA = ("doc_id long, n_shingles long, d1 long, d2 long, "
              "u array<long>, sk0 long, sk1 long")


def _sketch(lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each minhash, packed into two words."""
    words = []
    for half in (lows[:32], lows[32:64]):
        w = np.zeros(lows.shape[1], np.uint64)
        for k, row in enumerate(half):
            w |= (C.mix(row) & U64(3)) << U64(2 * k)
        words.append(w.view(np.int64))
    return words[0], words[1]


def _signatures(p: MinHashParams):
    k = p.collections * p.per_collection
    rng = np.random.default_rng(p.seed)
    mul = rng.integers(0, 2 ** 64, size=k, dtype=np.uint64) | U64(1)
    xor = rng.integers(0, 2 ** 64, size=k, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.texts_of(batch.column(1))
            for a, b in C.row_chunks(off):
                h, border = C.word_hashes(data, off[a:b + 1], C.SPACE_WORDS)
                sh, at = C.shingles(h, border, p.shingle)
                n = np.diff(at)
                full = np.flatnonzero(n > 0)
                first = at[:-1][full]
                sums = np.zeros((2, b - a), np.uint64)
                lows = np.zeros((k, len(full)), np.uint64)
                if len(full):
                    sums[0, full] = np.add.reduceat(C.mix(sh ^ U64(11)), first)
                    sums[1, full] = np.add.reduceat(C.mix(sh ^ U64(23)), first)
                    for j in range(k):
                        lows[j] = np.minimum.reduceat((sh ^ xor[j]) * mul[j],
                                                      first)
                u = np.zeros((p.collections, b - a), np.uint64)
                for i in range(p.collections):
                    v = np.full(len(full), i + 1, np.uint64)
                    for row in lows[i * p.per_collection:
                                    (i + 1) * p.per_collection]:
                        v = C.mix(v ^ row)
                    u[i, full] = v
                sk = np.zeros((2, b - a), np.int64)
                sk[:, full] = _sketch(lows)
                flat = pa.array(u.T.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(b - a + 1, dtype=np.int32)
                             * p.collections), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array(n.astype(np.int64)),
                     pa.array(sums[0].view(np.int64)),
                     pa.array(sums[1].view(np.int64)), lists,
                     pa.array(sk[0]), pa.array(sk[1])],
                    names=["doc_id", "n_shingles", "d1", "d2", "u", "sk0",
                           "sk1"])
    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.texts_of(batch.column(1))
            for a, b in C.row_chunks(off):
                h, border = C.word_hashes(data, off[a:b + 1], C.SPACE_WORDS)
                sh, at = C.shingles(h, border, width)
                raw = [sh[at[i]:at[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array(raw, pa.binary())], names=["id", "elements"])
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3),
                                           strict=True)):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                same = int((y[at] == x).sum())
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            idx = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(idx), batch.column(1).take(idx)],
                names=["a", "b"])
    return run


def _possible(pairs: DataFrame, sets: DataFrame, p: MinHashParams
              ) -> DataFrame:
    """Pairs whose sizes and minhash sketches allow the threshold."""
    info = sets.select("id", "n", "sk0", "sk1")
    x = info.select(*[F.col(c).alias(f"{c}_a") for c in info.columns])
    y = info.select(*[F.col(c).alias(f"{c}_b") for c in info.columns])
    j = pairs.join(x, F.col("a") == F.col("id_a")).join(
        y, F.col("b") == F.col("id_b"))
    k = p.collections * p.per_collection
    s = p.percent / 100.0
    # 2-bit values differ for a quarter less than the minhashes themselves
    miss = 0.75 * (1 - s)
    most = int(k * miss + 5.4 * (k * miss * (1 - miss)) ** 0.5) + 1

    def differ(c: str) -> str:
        d = f"({c}_a ^ {c}_b)"
        return (f"bit_count(({d} | shiftrightunsigned({d}, 1)) "
                "& 6148914691236517205L)")
    return (j.where(F.expr(
        f"100L * least(n_a, n_b) >= {p.percent}L * greatest(n_a, n_b)"))
        .where(F.expr(f"{differ('sk0')} + {differ('sk1')} <= {most}"))
        .select("a", "b"))


def _across(bucket_rows: DataFrame, comp: DataFrame, full: DataFrame,
            p: MinHashParams) -> DataFrame:
    """Links between sets of one bucket that are in two components.

    The sets of such a bucket outside its largest component are compared
    with all of the bucket's.  Buckets with the same largest component
    share their sets (a superset of the pairs), which travel in blocks of
    bounded bytes: a pair of blocks is a row, and only links come out.
    """
    kc = (bucket_rows.join(comp, "id", "left")
          .select("key", "id", F.coalesce("component", "id").alias("comp")))
    per = kc.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = (per.groupBy("key").agg(F.count("*").alias("k"),
                                    F.max(F.struct("c", "comp")).alias("top"))
             .where("k > 1").select("key", F.col("top.comp").alias("main")))
    met = C.cut(kc.join(mixed, "key").select("main", "id", "comp").distinct())
    sets = _with_sketches(full.join(met.select("id").distinct(), "id",
                                    "left_semi"), p)
    rows = C.save(met.join(sets, "id"), "minhash-across")
    size = F.octet_length("elements")
    outside = F.col("comp") != F.col("main")
    blocks = rows.groupBy("main").agg(
        F.ceil(F.sum(size) / p.block_bytes).alias("ny"),
        F.ceil(F.sum(F.when(outside, size)) / p.block_bytes).alias("nx"))
    # a component with very many sets is dealt out by a salt
    salts = F.sequence(F.lit(0), F.lit(p.salts - 1))
    blocks = C.cut(blocks).withColumn("salt", F.explode(salts))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(p.salts))
                           .cast("int")).join(blocks, ["main", "salt"])
    item = F.struct("id", "comp", "elements", "sketch")

    def packed(part: DataFrame, count: str, out: str) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(1), "id"), F.col(count))
        return part.withColumn(f"b{out}", block).groupBy(
            "main", f"b{out}", "ny").agg(F.collect_list(item).alias(out))
    left = packed(rows.where(outside), "nx", "x").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.least(
            "ny", F.lit(p.salts)) - 1))).drop("ny")
    right = packed(rows, "ny", "y").withColumn(
        "salt", F.pmod("by", F.lit(p.salts))).drop("ny")
    pairs = left.join(right, ["main", "salt"])
    return C.cut(pairs.repartition("main", "bx", "by").select("x", "y")
                 .mapInArrow(_compare_blocks(p.percent), "a long, b long")
                 .distinct())


# Bits of the sketch that stands before a full comparison.
_BITS = 512


def _with_sketches(full: DataFrame, p: MinHashParams) -> DataFrame:
    """(id, elements, sketch): a bit of each of 512 more minhashes."""
    rng = np.random.default_rng([p.seed, _BITS])
    mul = rng.integers(0, 2 ** 64, size=_BITS, dtype=np.uint64) | U64(1)
    xor = rng.integers(0, 2 ** 64, size=_BITS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.texts_of(batch.column(1))
            bits = np.zeros((batch.num_rows, _BITS), np.uint8)
            for a, b in C.row_chunks(off):      # a set has elements
                sh = np.frombuffer(data[off[a]:off[b]].tobytes(), np.uint64)
                first = (off[a:b] - off[a]) // 8
                for j in range(_BITS):
                    low = np.minimum.reduceat((sh ^ xor[j]) * mul[j], first)
                    bits[a:b, j] = C.mix(low) & U64(1)
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([r.tobytes() for r in packed], pa.binary())],
                names=["id", "elements", "sketch"])
    return full.mapInArrow(run, "id long, elements binary, sketch binary")


def _most_bits(percent: int) -> int:
    """Sketch bits in which sets at the threshold differ at most, but for a
    chance of less than one in a million."""
    miss = (1 - percent / 100.0) / 2
    return int(_BITS * miss + 5.4 * (_BITS * miss * (1 - miss)) ** 0.5) + 1


def _compare_blocks(percent: int):
    """Per set of the first block, one link to each component of the
    second that holds a similar set."""
    most, tile = _most_bits(percent), 512

    def sets(item) -> tuple:
        s = item.values
        e = [np.frombuffer(x.as_buffer(), np.uint64)
             for x in s.field("elements")]
        sketch = np.frombuffer(b"".join(s.field("sketch").to_pylist()),
                               np.uint64).reshape(len(e), -1)
        return (s.field("id").to_numpy(), s.field("comp").to_numpy(), e,
                sketch, np.array([len(x) for x in e]))

    def possible(xc, xk, xn, yc, yk, yn) -> np.ndarray:
        """Which pairs of a tile sizes and sketches allow."""
        differ = np.zeros((len(xc), len(yc)), np.uint16)
        for w in range(xk.shape[1]):
            differ += np.bitwise_count(xk[:, w, None] ^ yk[None, :, w])
        small = np.minimum(xn[:, None], yn[None, :])
        large = np.maximum(xn[:, None], yn[None, :])
        return ((differ <= most) & (xc[:, None] != yc[None, :])
                & (100 * small >= percent * large))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for xs, ys in zip(batch.column(0), batch.column(1), strict=True):
                xi, xc, xe, xk, xn = sets(xs)
                yi, yc, ye, yk, yn = sets(ys)
                for s in range(0, len(xi), tile):
                    ok = possible(xc[s:s + tile], xk[s:s + tile],
                                  xn[s:s + tile], yc, yk, yn)
                    for i in np.flatnonzero(ok.any(axis=1)):
                        e, js = xe[s + i], np.flatnonzero(ok[i])
                        flat = np.concatenate([ye[j] for j in js])
                        at = np.minimum(np.searchsorted(e, flat), len(e) - 1)
                        n = yn[js]
                        same = np.add.reduceat((e[at] == flat).astype(
                            np.int64), np.cumsum(n) - n)
                        near = js[100 * same >= percent * (
                            len(e) + n - same)]
                        _, one = np.unique(yc[near], return_index=True)
                        b.append(yi[near[one]])
                        a.append(np.full(len(one), xi[s + i]))
            a = np.concatenate(a) if a else np.empty(0, np.int64)
            b = np.concatenate(b) if b else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b).astype(np.int64)),
                 pa.array(np.maximum(a, b).astype(np.int64))],
                names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams(),
                    id_col: str = "doc_id", text_col: str = "text"
                    ) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable by confirmed links,
    ``kept`` marks the document that stays of each component.  Texts that
    are null, empty or blank have no shingles and link with nothing.  A
    row without an id is in no component (component_id null) and is kept.
    Rows that repeat an id are one node; all rows come back.  Other
    columns of ``docs`` are not read, whatever their names.
    """
    docs = C.own_columns(docs, {id_col: "doc_id", text_col: "text"}).select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return C.result_of(lambda: _near_duplicates(docs, params),
                       docs.sparkSession, "minhash")


def _near_duplicates(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """``near_duplicates`` of (doc_id, text)."""
    sets = C.save(docs.mapInArrow(_signatures(p), SET_SCHEMA), "minhash-sets")
    named = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["d1", "d2", "n_shingles"]
    groups = named.groupBy(*digest).agg(F.min("doc_id").alias("id"),
                                        F.count("*").alias("copies"))
    groups = C.save(groups, "minhash-groups")
    reps = (named.join(groups.select(*digest, F.col("id").alias("doc_id")),
                       [*digest, "doc_id"], "left_semi")
            .dropDuplicates(["doc_id", *digest])
            .select(F.col("doc_id").alias("id"),
                    F.col("n_shingles").alias("n"), "u", "sk0", "sk1"))
    reps = C.save(reps, "minhash-reps")

    # Collections whose value another set shares, and their tensor keys.
    pos = reps.select("id", F.explode("u").alias("v"))
    shared = pos.groupBy("v").agg(F.count("*").alias("c")).where(
        "c > 1").select("v")
    both = (pos.join(shared, "v").groupBy("id")
            .agg(F.sort_array(F.collect_set("v")).alias("vs"))
            .where("size(vs) > 1"))
    keys = both.select("id", F.explode(F.expr(
        "flatten(transform(vs, (x, i) -> transform("
        "slice(vs, i + 2, size(vs)), y -> xxhash64(x, y))))")).alias("key"))
    keys = C.save(keys, "minhash-keys")
    buckets = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = C.save(buckets, "minhash-buckets")

    # First links: in each bucket the set that meets most others stands for
    # it, and every set proposes the one it shares most tables with.
    bucket_rows = C.save(keys.join(buckets, "key"), "minhash-bucket-rows")
    degree = bucket_rows.groupBy("id").agg(F.sum("c").alias("deg"))
    hubs = (bucket_rows.join(degree, "id").groupBy("key")
            .agg(F.max(F.struct(F.col("deg"), (-F.col("id")).alias("neg")))
                 .alias("hub"))
            .select("key", (-F.col("hub.neg")).alias("hub")))
    first = (bucket_rows.join(hubs, "key").where("id <> hub")
             .groupBy("id", "hub").agg(F.count("*").alias("tables"))
             .groupBy("id").agg(F.max(F.struct(
                 F.col("tables"), (-F.col("hub")).alias("neg"))).alias("top"))
             .select(F.least("id", -F.col("top.neg")).alias("a"),
                     F.greatest("id", -F.col("top.neg")).alias("b"))
             .distinct())
    first = _possible(first, reps, p)
    ids = C.cut(bucket_rows.select("id").distinct())
    full = C.save(
        C.semi_join(docs.withColumnRenamed("doc_id", "id"), ids, "id")
        .mapInArrow(_full_sets(p.shingle), "id long, elements binary")
        .dropDuplicates(["id", "elements"]), "minhash-elements")
    x = full.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    y = full.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    links = C.cut(first.join(x, "a").join(y, "b").select("a", "b", "x", "y")
                  .mapInArrow(_confirm(p.percent), "a long, b long"))
    comp = C.components(links)

    # Then all sets that share a bucket across components.
    more = _across(bucket_rows, comp, full, p)
    if not more.isEmpty():
        comp = C.components(links.union(more))

    named_groups = groups.join(comp, "id", "left").select(
        *digest, F.coalesce("component", "id").alias("component_id"),
        "copies", "id").where("copies > 1 OR component_id <> id")
    out = sets.select("doc_id", *digest).join(
        named_groups.select(*digest, "component_id"), digest, "left")
    # an empty text, like a row without an id, is its own component
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(),
                    F.col("component_id"))
    out = out.withColumn("component_id", F.coalesce(linked, F.col("doc_id")))
    return out.select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, params: MinHashParams = MinHashParams(),
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of each group one row stays, the one
    with the smallest id (a row without an id only if no other is there;
    ties by text and by the other columns).

    A group is of texts, not of ids: rows without an id are copies like any
    other, and rows that share an id go only by their own texts.  Rows
    without words are no copies and all stay.  The columns are those of
    ``docs``, and none must be named ``__digest`` or ``__row``.
    """
    marked = _marked(docs, text_col)
    counted = C.result_of(lambda: _judged(docs, params, id_col, text_col),
                          docs.sparkSession, "minhash-judged")
    key = ["__digest", "__row"]
    gone = counted.where("NOT chosen OR c > 1").select(*key)
    out = marked.join(gone, key, "left_anti")
    repeated = counted.where("chosen AND c > 1").select(*key)
    if not repeated.isEmpty():      # equal rows: one of them stays
        out = out.unionByName(marked.join(repeated, key, "left_semi")
                              .dropDuplicates(key))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _marked(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the digest of the text and a hash of the whole row:
    together 192 bits that tell a row."""
    columns = [x for c in docs.columns
               for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    text = F.col(f"`{text_col}`").cast("string")
    return docs.withColumns({"__digest": F.md5(text.cast("binary")),
                             "__row": F.xxhash64(*columns)})


def _judged(docs: DataFrame, p: MinHashParams, id_col: str, text_col: str
            ) -> DataFrame:
    """(__digest, __row, c, chosen) of the rows in groups: how many rows are
    equal, and whether they are what stays of their group."""
    text = F.col(f"`{text_col}`").cast("string")
    node = F.xxhash64(text)         # a text stands for its rows by it
    marked = _marked(docs, text_col)
    rows = C.save(marked.where(text.isNotNull()).select(
        node.alias("node"), "__digest", "__row",
        F.col(f"`{id_col}`").cast("long").alias("id")), "minhash-rows")
    verdicts = near_duplicates(docs.where(text.isNotNull()).select(
        node.alias("doc_id"), text.alias("text")), p)
    groups = verdicts.where("n_shingles > 0").select(
        F.col("doc_id").alias("node"), F.col("component_id").alias("group")
    ).distinct()
    # should two texts have one node, their rows stay
    clash = rows.groupBy("node").agg(
        (F.min("__digest") != F.max("__digest")).alias("bad"))
    groups = groups.join(clash.where("NOT bad").select("node"), "node")
    members = C.save(rows.join(groups, "node"), "minhash-members")
    stays = members.groupBy("group").agg(F.min(F.struct(
        F.col("id").isNull().alias("none"), "id", "__digest", "__row")
    ).alias("s")).select("group", F.col("s.__digest").alias("d"),
                         F.col("s.__row").alias("r"))
    counted = members.groupBy("group", "__digest", "__row").agg(
        F.count("*").alias("c")).join(stays, "group")
    chosen = (F.col("__digest") == F.col("d")) & (F.col("__row") == F.col("r"))
    return counted.select("__digest", "__row", "c", chosen.alias("chosen"))
