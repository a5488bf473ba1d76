"""Centroid clustering of integer vectors on bit planes.

A vector of 64 components becomes integers floor(scale * x); bit plane b
packs bit b of all 64 components (two's complement) into one 64-bit word.
With plane weights w (2^b, the top plane -2^b) the dot product with a
centroid is exact:

    x . c = sum over planes i, j of w_i w_j popcount(x_i AND c_j)

and so is the squared distance |x|^2 - 2 x.c + |c|^2.  A vector keeps as
few planes as its components need, so one wide vector widens no other.

Each Lloyd round is one pass over the packed vectors: a task assigns its
vectors and adds up each cluster's components and members; Spark adds the
tasks' sums.  The centroids, ``k`` times 64 integers, are the only thing
that passes through the driver, and are sent out again with the next pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 64
# Integers of at most so many bits: a squared distance fits in 63 bits.
MAX_BITS = 28
_TILE = 1024


@dataclass(frozen=True)
class CentroidParams:
    k: int = 40
    rounds: int = 5
    scale: int = 256
    seed: int = 2


def bits_needed(values: np.ndarray) -> np.ndarray:
    """Planes of each row's integers: two's complement, at least one."""
    top = np.where(values < 0, -values - 1, values).max(axis=1)
    return np.frexp(top.astype(np.float64))[1].astype(np.int64) + 1


def pack_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits) words: bit c of word b is bit b of component c."""
    planes = (values[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    packed = np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(
        len(values), bits)


def plane_weights(bits: int) -> np.ndarray:
    w = np.int64(1) << np.arange(bits, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def unpack_planes(planes: np.ndarray) -> np.ndarray:
    """The integers again, (n, 64)."""
    n, bits = planes.shape
    b = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8),
                      bitorder="little").reshape(n, bits, WIDTH)
    return np.einsum("nbc,b->nc", b, plane_weights(bits))


def dot_planes(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products (n, k) of packed vectors with packed centroids."""
    wx, wc = plane_weights(x.shape[1]), plane_weights(c.shape[1])
    out = np.zeros((len(x), len(c)), np.int64)
    for i in range(x.shape[1]):
        part = np.zeros((len(x), len(c)), np.int64)
        for j in range(c.shape[1]):
            both = np.bitwise_count(x[:, i, None] & c[None, :, j])
            part += both * wc[j]
        out += part * wx[i]
    return out


def nearest(x: np.ndarray, c: np.ndarray, c_norm: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid; of equally near
    ones the smaller number."""
    cluster = np.empty(len(x), np.int64)
    dist = np.empty(len(x), np.int64)
    for s in range(0, len(x), _TILE):
        t = x[s:s + _TILE]
        own = unpack_planes(t)
        d = c_norm[None, :] - 2 * dot_planes(t, c)
        best = d.argmin(axis=1)
        cluster[s:s + _TILE] = best
        dist[s:s + _TILE] = (d[np.arange(len(t)), best]
                             + np.einsum("nc,nc->n", own, own))
    return cluster, dist


def _pack(scale: int):
    """Rows (vec_id, planes): kept vectors, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            size = np.asarray(v.value_lengths().fill_null(-1))
            at = np.flatnonzero(size == WIDTH)
            if not len(at):
                continue
            # the components of the rows of the right length, nulls as NaN
            flat = v.take(pa.array(at)).flatten().to_numpy(
                zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)
            fine = np.isfinite(flat).all(axis=1)
            at, flat = at[fine], np.floor(flat[fine] * scale)
            if not len(at):
                continue
            if np.abs(flat).max() >= 2.0 ** (MAX_BITS - 1):
                raise OverflowError(
                    f"a component times {scale} needs more than {MAX_BITS} "
                    "bits: a squared distance would not fit in a long")
            values = flat.astype(np.int64)
            need = bits_needed(values)
            planes: list = [None] * len(at)
            for bits in np.unique(need):
                rows = np.flatnonzero(need == bits)
                packed = pack_planes(values[rows], int(bits))
                for r, p in zip(rows.tolist(), packed, strict=True):
                    planes[r] = p.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)),
                 pa.array(planes, pa.binary())], names=["vec_id", "planes"])
    return run


def _assigned(batch: pa.RecordBatch, column: int, c: np.ndarray,
              norm: np.ndarray) -> Iterator[tuple]:
    """(rows, planes, cluster, distance) for the rows of each width."""
    data, offsets = C.texts_of(batch.column(column))
    words = np.diff(offsets) // 8
    for bits in np.unique(words):
        rows = np.flatnonzero(words == bits)
        at = offsets[rows][:, None] + np.arange(8 * bits)[None, :]
        x = np.ascontiguousarray(data[at]).view(np.uint64).reshape(
            len(rows), int(bits))
        cluster, dist = nearest(x, c, norm)
        yield rows, x, cluster, dist


def _packed_centroids(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = int(bits_needed(centroids).max())
    return (pack_planes(centroids, bits),
            np.einsum("kc,kc->k", centroids, centroids))


def _sums(centroids: np.ndarray):
    """Per task: (cluster, members, component sums)."""
    c, norm = _packed_centroids(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(c), WIDTH), np.int64)
        members = np.zeros(len(c), np.int64)
        for batch in batches:
            for _, x, cluster, _ in _assigned(batch, 0, c, norm):
                order = np.argsort(cluster, kind="stable")
                here, first = np.unique(cluster[order], return_index=True)
                total[here] += np.add.reduceat(
                    unpack_planes(x)[order], first, axis=0)
                members += np.bincount(cluster, minlength=len(c))
        at = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(members[at]),
             pa.array(list(total[at]), pa.list_(pa.int64()))],
            names=["cluster", "members", "sums"])
    return run


def _final(centroids: np.ndarray):
    c, norm = _packed_centroids(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = np.empty(batch.num_rows, np.int32)
            dist = np.empty(batch.num_rows, np.int64)
            for rows, _, cl, d in _assigned(batch, 1, c, norm):
                cluster[rows], dist[rows] = cl, d
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster), pa.array(dist)],
                names=["vec_id", "cluster", "distance"])
    return run


def first_centroids(packed: DataFrame, p: CentroidParams) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their id, in its order.
    Vectors without an id come after all others; ties go by the planes."""
    key = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("vec_id").cast(
        "string")).cast("binary"), 256)
    top = packed.orderBy(key.asc_nulls_last(), "planes").limit(p.k).collect()
    return np.array([unpack_planes(np.frombuffer(
        r["planes"], np.uint64)[None, :])[0] for r in top],
        np.int64).reshape(-1, WIDTH)


def next_centroids(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: assign, then floor(sum / count) of every component of
    the clusters that have members; the others stay."""
    rows = (packed.select("planes").mapInArrow(
        _sums(centroids), "cluster long, members long, sums array<long>")
        .select("cluster", "members", F.posexplode("sums").alias("c", "s"))
        .groupBy("cluster", "c").agg(
            F.sum(F.col("s").cast("decimal(38,0)")).alias("s"),
            F.sum("members").alias("members")).collect())
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["c"]] = int(r["s"]) // r["members"]
    return out


def fit_centroids(packed: DataFrame, p: CentroidParams) -> np.ndarray:
    centroids = first_centroids(packed, p)
    for _ in range(p.rounds if len(centroids) else 0):
        centroids = next_centroids(packed, centroids)
    return centroids


def cluster_vectors(embeddings: DataFrame,
                    params: CentroidParams = CentroidParams(),
                    id_col: str = "vec_id", vector_col: str = "embedding"
                    ) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared),
    cluster_inertia, inertia, centroid (its final integers).

    Kept are vectors of exactly 64 components, none null or non-finite;
    other rows are not in the result.  Fewer kept vectors than ``k`` give as
    many clusters; an empty table gives no row.  Rows that repeat an id are
    vectors of their own; a vector without an id is assigned like any other
    and starts a cluster only if too few others are there.  A component of
    more than 28 bits raises OverflowError.  Other columns are not read.
    """
    rows = C.own_columns(embeddings, {id_col: "vec_id", vector_col: "v"}
                         ).select(F.col("vec_id").cast("long"),
                                  F.col("v").cast("array<double>"))
    return C.result_of(lambda: _cluster(rows, params),
                       embeddings.sparkSession, "centroids")


def _cluster(rows: DataFrame, p: CentroidParams) -> DataFrame:
    packed = C.save(rows.mapInArrow(
        _pack(p.scale), "vec_id long, planes binary"), "centroids-packed")
    centroids = fit_centroids(packed, p)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return packed.select(
            "vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias(
                "distance"), F.lit(0).cast("long").alias("cluster_inertia"),
            F.lit(0).cast("long").alias("inertia"),
            F.lit(None).cast("array<long>").alias("centroid"))
    found = C.save(packed.mapInArrow(_final(centroids), schema),
                   "centroids-found")
    # one row per cluster
    per = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    total = sum(int(r["d"]) for r in per)
    facts = found.sparkSession.createDataFrame(
        [(r["cluster"], int(r["d"]), total,
          centroids[r["cluster"]].tolist()) for r in per],
        "cluster int, cluster_inertia long, inertia long, "
        "centroid array<long>")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        "centroid")
