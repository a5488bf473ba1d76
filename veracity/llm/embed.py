"""Embedding near-duplicates by sorted projection passes.

Each pass draws random hyperplanes; the sides a vector lies on, one after
the other, are its code.  The vectors are ordered by code and each is
compared with its neighbours:

* with the next ``window`` ones in the order, and
* with all that share the code's leading bits, however many they are.  The
  number of leading bits is such that evenly spread codes put about a
  window of vectors into such a run; a run that is longer (a dense
  cluster) is compared whole, so no neighbour is lost to the window.

The order is dealt out by some fewer leading bits, a task each; a task
also gets the first part of the next one's vectors, so windows reach over
the borders.  A stretch of very many vectors is dealt into salted blocks,
and every two of its blocks meet in a task of their own.

A pass looks twice.  The first look ships a code and a sketch of 128 more
sides per vector and finds who has a possible partner; only these ship
their vectors for the second look, which decides in double precision.

Equal vectors are one entry with a count.  A pair belongs to the first
pass whose leading bits agree, which both rows' codes tell, so a task adds
up links without the pairs of other tasks: it returns a count per vector
and, instead of every pair, a star per connected group.  Pairs that only a
window has found are few; they are listed and made distinct.

The passes are chosen from the number of vectors: a pass finds a pair when
all leading bits agree, each with probability 1 - angle / pi, and a pair
right at the threshold is found in one of them with probability
``recall``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
# Bits of a code, of which the first ones deal out; sides of a sketch.
CODE_BITS, SKETCH_WORDS = 60, 2
# A task holds so many windows if codes are even: 2 ** DEAL_BITS.
DEAL_BITS = 3


@dataclass(frozen=True)
class EmbedParams:
    cosine: float = 0.9
    window: int = 512
    recall: float = 0.99
    seed: int = 3


def leading_bits(n: int, p: EmbedParams) -> int:
    """Bits whose runs hold one to two windows if codes are even."""
    return max(0, min(31, int(math.log2(max(n, 1) / p.window))
                      if n > p.window else 0))


def passes_for(n: int, p: EmbedParams) -> int:
    """Passes that find a pair at the threshold with probability recall."""
    once = (1 - math.acos(p.cosine) / math.pi) ** leading_bits(n, p)
    if once >= p.recall:
        return 1
    return math.ceil(math.log(1 - p.recall) / math.log(1 - once))


def sketch_limit(p: EmbedParams) -> int:
    """Sides in which a pair at the threshold differs at most, but for a
    chance of less than one in a million."""
    n, d = 64 * SKETCH_WORDS, math.acos(max(-1.0, min(1.0, p.cosine))
                                        ) / math.pi
    return min(n, int(n * d + 5.4 * math.sqrt(n * d * (1 - d))) + 1)


# --- vectors and codes -------------------------------------------------------

def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes: of 32 bits if no component loses by it,
    else of 64; a zero has one form."""
    for batch in batches:
        v = batch.column(1)
        size = np.asarray(v.value_lengths().fill_null(0))
        raw: list[bytes | None] = [None] * len(size)
        wide = np.zeros(len(size), bool)
        for d in np.unique(size[size > 0]):
            at = np.flatnonzero(size == d)
            x = v.take(pa.array(at)).flatten().to_numpy(
                zero_copy_only=False).astype(np.float64).reshape(-1, d) + 0.0
            use = np.isfinite(x).all(axis=1) & x.any(axis=1)
            at, x = at[use], x[use]
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            wide[at] = (short != x).any(axis=1)
            for i, a, b in zip(at.tolist(), x, short, strict=True):
                raw[i] = (a if wide[i] else b).tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(raw, pa.binary()), pa.array(wide)],
            names=["vec_id", "raw", "wide"])


def _unit(raw: np.ndarray, wide: bool) -> np.ndarray:
    """Rows of bytes as unit vectors in double precision."""
    x = raw.view(np.float64 if wide else np.float32).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _rows(data: np.ndarray, at: np.ndarray, rows: np.ndarray, size: int
          ) -> np.ndarray:
    """The bytes of some rows of equal size, a row each."""
    if not len(rows):
        return np.empty((0, size), np.uint8)
    return np.ascontiguousarray(
        data[at[rows][:, None] + np.arange(size)[None, :]])


def _packed(side: np.ndarray, bits: int) -> np.ndarray:
    """(n, passes * bits) sides as (n, passes) numbers, first side first."""
    cut = side.reshape(len(side), -1, bits).astype(np.uint64)
    return cut @ (U64(1) << np.arange(bits, dtype=np.uint64)[::-1])


def _codes(p: EmbedParams, passes: int, shift: int):
    """Entries with their codes of all passes, the codes' leading bits and
    a sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            data, at = C.texts_of(batch.column(2))
            wide = batch.column(3).to_numpy(zero_copy_only=False)
            size = np.diff(at)
            dims = np.where(wide, size // 8, size // 4)
            code = np.zeros((len(size), passes), np.uint64)
            sketch = np.zeros((len(size), SKETCH_WORDS), np.uint64)
            for d in np.unique(dims):
                if d not in planes:
                    rng = np.random.default_rng([p.seed, int(d)])
                    planes[d] = rng.standard_normal(
                        (int(d), passes * CODE_BITS + 64 * SKETCH_WORDS))
                for w in (False, True):
                    rows = np.flatnonzero((dims == d) & (wide == w))
                    if not len(rows):
                        continue
                    unit = _unit(_rows(data, at, rows, int(size[rows[0]])), w)
                    side = unit @ planes[d] > 0
                    code[rows] = _packed(side[:, :passes * CODE_BITS],
                                         CODE_BITS)
                    sketch[rows] = _packed(side[:, passes * CODE_BITS:], 64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array(dims.astype(np.int32)),
                 pa.array(list(code.view(np.int64)),
                          pa.list_(pa.int64())),
                 pa.array([c.tobytes() for c in (
                     code >> U64(shift)).astype(np.uint32)], pa.binary()),
                 pa.array([s.tobytes() for s in sketch], pa.binary()),
                 batch.column(2), batch.column(3)],
                names=["id", "copies", "dim", "code", "leads", "sketch",
                       "raw", "wide"])
    return run


# --- comparing ---------------------------------------------------------------

def _pairs(code: np.ndarray, guest: np.ndarray, x: np.ndarray,
           y: np.ndarray, own: bool, window: int, shift: int, near,
           tile: int = 512
           ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (places in x's and y's rows) of sorted neighbours.

    ``x`` and ``y`` are rows in code order (the same ones with ``own``).  A
    pair is looked at if the leading bits agree or, with ``own``, if it is
    within the window; two guests of a part meet at home.  ``near(i, j)``
    returns which rows of i and j, as a mask, are near."""
    lead_x, lead_y = code[x] >> U64(shift), code[y] >> U64(shift)
    for s in range(0, len(x), tile):
        i = x[s:s + tile]
        # rows of y that a row of the tile may meet: a contiguous stretch
        lo = int(np.searchsorted(lead_y, lead_x[s], "left"))
        hi = int(np.searchsorted(lead_y, lead_x[min(s + tile, len(x)) - 1],
                                 "right"))
        if own:
            lo, hi = s, max(hi, min(len(y), s + len(i) + window))
        for t in range(lo, hi, tile):
            j = y[t:min(t + tile, hi)]
            a, b = np.nonzero(near(i, j))
            ok = lead_x[s + a] == lead_y[t + b]
            if own:
                ok |= t + b - s - a <= window
                ok &= (t + b > s + a) & ~guest[i[a]]
            yield i[a[ok]], j[b[ok]]


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each node's connected group."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root[root], root):
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, read
             ) -> Iterator[tuple[tuple, tuple]]:
    """(key, columns) of each task: consecutive rows with equal key, their
    columns as ``read(batch, a, b)`` gives them."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy().astype(np.int64)
                        for c in range(keys)], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)],
                        strict=True):
            here = tuple(key[a].tolist())
            if here != now and parts:
                yield now, tuple(map(np.concatenate, zip(*parts)))
                parts = []
            now = here
            parts.append(read(batch, a, b))
    if parts:
        yield now, tuple(map(np.concatenate, zip(*parts)))


def _sides(key: tuple, side: np.ndarray, code: np.ndarray, down: int
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Which rows are guests, and the rows of the task's two blocks in
    code order."""
    part, u, v = key[2:]
    order = np.argsort(code, kind="stable")
    guest = (code >> U64(down)) != U64(part) if down < CODE_BITS else (
        np.zeros(len(code), bool))
    return (guest, order[side[order] == u], order[side[order] == v], u == v)


def _active(p: EmbedParams, shift: int, down: int):
    """First look: (id, pass) of the rows whose sketch comes near that of a
    neighbour."""
    limit = sketch_limit(p)

    def read(batch, a, b):
        data, at = C.texts_of(batch.column("sketch").slice(a, b - a))
        sketch = np.frombuffer(data[at[0]:at[-1]].tobytes(), np.uint64)
        return (*[batch.column(c).to_numpy()[a:b].copy()
                  for c in ("side", "id", "code")],
                sketch.reshape(b - a, SKETCH_WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (side, ids, code, sketch) in _grouped(batches, 5, read):
            code = code.view(np.uint64)
            hit = np.zeros(len(ids), bool)

            def near(i, j):
                d = np.zeros((len(i), len(j)), np.uint8)
                for w in range(SKETCH_WORDS):
                    d += np.bitwise_count(sketch[i, w][:, None]
                                          ^ sketch[j, w][None, :])
                return d <= limit
            guest, x, y, own = _sides(key, side, code, down)
            for i, j in _pairs(code, guest, x, y, own, p.window, shift, near):
                hit[i] = hit[j] = True
            found = np.unique(ids[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.full(len(found), key[0]),
                                           pa.int32())],
                names=["id", "pass"])
    return run


def _compare(p: EmbedParams, shift: int, down: int, every: bool):
    """Second look, at the vectors.  Rows (id, other, n):

    * ``n``: so many links of ``id``, counted here and nowhere else;
    * ``other`` alone: both are in one connected group;
    * ``other`` with n = 0: a pair that only a window has found.

    With ``every`` each pair is listed, as the last kind."""
    def read(batch, a, b):
        wide = batch.column("wide").to_numpy(zero_copy_only=False)[a:b]
        data, at = C.texts_of(batch.column("leads").slice(a, b - a))
        leads = np.frombuffer(data[at[0]:at[-1]].tobytes(), np.uint32)
        data, at = C.texts_of(batch.column("raw").slice(a, b - a))
        dim = int(batch.column("dim").to_numpy()[a])
        unit = np.empty((b - a, dim), np.float64)
        for w in (False, True):
            rows = np.flatnonzero(wide == w)
            if len(rows):
                unit[rows] = _unit(_rows(data, at, rows, dim * (8 if w else 4)
                                         ), w)
        return (*[batch.column(c).to_numpy()[a:b].copy()
                  for c in ("side", "id", "copies", "code")],
                leads.reshape(b - a, -1), unit)

    def task(key, cols) -> Iterator[pa.RecordBatch]:
        k = key[0]
        side, ids, copies, code, leads, unit = cols
        code = code.view(np.uint64)
        count = np.zeros(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = np.arange(len(ids))
        guest, x, y, own = _sides(key, side, code, down)

        def near(i, j):
            return unit[i] @ unit[j].T >= p.cosine - 1e-9
        for i, j in _pairs(code, guest, x, y, own, p.window, shift, near):
            # the decision itself: products and sums in double precision
            keep = np.einsum("ij,ij->i", unit[i], unit[j]) >= p.cosine
            i, j = i[keep], j[keep]
            agree = leads[i] == leads[j]
            first, meets = agree.argmax(axis=1), agree.any(axis=1)
            only = np.arange(len(i)) if every else np.flatnonzero(~meets)
            yield _links(np.minimum(ids[i[only]], ids[j[only]]),
                         np.maximum(ids[i[only]], ids[j[only]]),
                         np.zeros(len(only), np.int64))
            if every:
                continue
            # those of this pass whose leading bits agree here first
            mine = np.flatnonzero(meets & (first == k))
            i, j = i[mine], j[mine]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            i, j = root[place[i]], root[place[j]]
            i, j = i[i != j], j[i != j]
            root = _stars(i, j, len(ids))[root] if len(i) else root
        at = np.flatnonzero(count)
        yield _links(ids[at], None, count[at])
        far = np.flatnonzero(root != np.arange(len(ids)))
        yield _links(ids[order[root[far]]], ids[order[far]], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cols in _grouped(batches, 5, read):
            yield from task(key, cols)
    return run


def _links(a, b, n) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()),
         none if b is None else pa.array(b, pa.int64()),
         none if n is None else pa.array(n, pa.int64())],
        names=["id", "other", "n"])


def _dealt(rows: DataFrame, down: int, p: EmbedParams, columns: list[str]
           ) -> DataFrame:
    """Rows (pass, dim, code, id, ...) as tasks (pass, dim, part, u, v),
    grouped and sorted by task.  ``part`` is the code without its ``down``
    last bits; a row at the beginning of a part is a guest of the one
    before, for windows to reach over the border."""
    key = ["pass", "dim", "part"]
    part = F.shiftright("code", down) if down < CODE_BITS else F.lit(
        0).cast("long")
    # the first share of a part: about a window if codes are even
    first = F.shiftright("code", down - DEAL_BITS).bitwiseAND(
        F.lit((1 << DEAL_BITS) - 1)) == 0
    rows = rows.withColumn("home", part).withColumn("part", F.explode(
        F.when(first & (F.col("home") > 0),
               F.array(F.col("home"), F.col("home") - 1))
        .otherwise(F.array("home"))))
    # rows of a block: several windows, fewer when vectors are long
    block = F.greatest(F.lit(p.window), F.least(
        F.lit(32 * p.window), (F.lit(1 << 22) / F.col("dim")).cast("int")))
    long = C.cut(rows.groupBy(*key).agg(F.count("*").alias("c"))
                 .withColumn("blocks", F.ceil(F.col("c") / block).cast("int"))
                 .where("blocks > 1").select(*key, "blocks"))
    if long.count() <= C.BROADCAST_ROWS:
        long = F.broadcast(long)
    rows = rows.join(long, key, "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1)))
    # a part that is dealt into blocks has no guests
    rows = rows.where("blocks = 1 OR part = home").withColumn(
        "side", F.pmod(F.xxhash64("id", "pass"), "blocks").cast("int"))
    rows = rows.withColumn("met", F.explode(F.expr(
        "sequence(0, blocks - 1)")))
    task = [*key, "u", "v"]
    return rows.select(
        *key, F.least("side", "met").alias("u"),
        F.greatest("side", "met").alias("v"), "side", "id", "code", *columns
    ).repartition(*task).sortWithinPartitions(*task)


def _linked(entries: DataFrame, p: EmbedParams, every: bool) -> DataFrame:
    """What ``_compare`` returns for entries (id, copies, raw, wide)."""
    n = entries.count()
    bits, passes = leading_bits(n, p), passes_for(n, p)
    shift = CODE_BITS - bits
    down = CODE_BITS - max(0, bits - DEAL_BITS)
    coded = C.save(entries.select("id", "copies", "raw", "wide").mapInArrow(
        _codes(p, passes, shift), "id long, copies long, dim int, "
        "code array<long>, leads binary, sketch binary, raw binary, "
        "wide boolean"), "embed-codes")
    look = coded.select("id", "dim", "sketch", F.posexplode("code").alias(
        "pass", "code"))
    active = _dealt(look, down, p, ["sketch"]).mapInArrow(
        _active(p, shift, down), "id long, pass int")
    # a vector is fetched once, for all passes in which it is active
    per = C.save(active.groupBy("id").agg(F.collect_set("pass").alias(
        "passes")), "embed-active")
    rows = coded.join(per, "id").withColumn("pass", F.explode("passes"))
    rows = rows.withColumn("code", F.element_at("code", F.col("pass") + 1))
    return _dealt(rows, down, p, ["copies", "leads", "raw", "wide"]
                  ).mapInArrow(_compare(p, shift, down, every),
                               "id long, other long, n long")


def near_pairs(entries: DataFrame, params: EmbedParams = EmbedParams()
               ) -> DataFrame:
    """Distinct pairs (a, b), a < b, found among entries (id, raw, wide),
    each a vector of its own."""
    return _linked(entries.withColumn("copies", F.lit(1).cast("long")),
                   params, True).select(
        F.col("id").alias("a"), F.col("other").alias("b")).distinct()


def link_vectors(embeddings: DataFrame, params: EmbedParams = EmbedParams(),
                 id_col: str = "vec_id", vector_col: str = "embedding"
                 ) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    A vector is an id and its components: rows that repeat both are one
    and come back as often as they were given; an id with several vectors
    has several.  ``n_links`` counts the other vectors that are near,
    equal ones included.  Components are over ids: the vectors of an id are
    in one component whether they are near or not.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing;
    vectors of different length never link.  A row without an id is kept,
    has no component and counts in nobody's links.  Other columns are not
    read.
    """
    rows = C.own_columns(embeddings, {id_col: "vec_id", vector_col: "v"}
                         ).select(F.col("vec_id").cast("long"),
                                  F.col("v").cast("array<double>"))
    return C.result_of(lambda: _link_vectors(rows, params),
                       embeddings.sparkSession, "embed")


def _link_vectors(rows: DataFrame, params: EmbedParams) -> DataFrame:
    rows = C.save(rows.mapInArrow(
        _plain, "vec_id long, raw binary, wide boolean").withColumn(
        "digest", F.when(F.col("vec_id").isNotNull(), F.sha2("raw", 256))),
        "embed-plain")
    named = rows.where("digest IS NOT NULL")
    vectors = named.select("vec_id", "digest").distinct()
    # an entry's number; its smallest id stands for it among the ids
    groups = C.save(vectors.groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("id", F.monotonically_increasing_id()), "embed-groups")
    entries = C.save(named.join(
        groups.withColumnRenamed("rep", "vec_id"), ["vec_id", "digest"])
        .dropDuplicates(["id"]).select("id", "copies", "raw", "wide"),
        "embed-entries")
    found = C.save(_linked(entries, params, False), "embed-links")

    alone = found.where("n = 0 AND other IS NOT NULL").select(
        "id", "other").distinct()
    alone = C.save(alone.union(alone.select("other", "id")), "embed-alone")
    sizes = groups.select(F.col("id").alias("other"), "copies")
    links = (found.where("other IS NULL").select("id", "n").union(
        alone.join(sizes, "other").select("id", "copies"))
        .groupBy("id").agg(F.sum("n").alias("others")))

    # components over ids: near entries, and entries that share an id
    reps = groups.select("id", "rep")
    near = (found.where("other IS NOT NULL").select("id", "other").distinct()
            .join(reps, "id").select("other", F.col("rep").alias("a"))
            .join(reps.withColumnsRenamed({"id": "other", "rep": "b"}),
                  "other").select("a", "b"))
    several = vectors.groupBy("vec_id").agg(F.count("*").alias("c")).where(
        "c > 1").select("vec_id")
    shared = (vectors.join(several, "vec_id").join(
        groups.select("digest", "rep"), "digest")
        .select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    comp = C.components(near.union(shared))

    info = (groups.join(links, "id", "left").join(
        comp.withColumnRenamed("id", "rep"), "rep", "left")
        .select("digest", (F.coalesce("others", F.lit(0)) + F.col("copies")
                           - 1).alias("links"),
                F.coalesce("component", "rep").alias("comp")))
    out = rows.select("vec_id", "digest").join(info, "digest", "left")
    component = F.coalesce("comp", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
