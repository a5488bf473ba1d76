"""Mixing sources to target weights along a training curriculum.

Each source has a weight schedule over the run, t from 0 to 1: knots
(t, w) joined by straight lines.  Its integral tells how much of the
source's target is due by t.  A document's first word has a place in its
source's stream of words (documents in seeded hash order, pass after
pass); inverting the integral at that place gives the training position,
and the mixed documents are range-sorted by it.

Targets: the budget is shared by weight; a source's target stops at
``cap`` times its size and the excess is shared again by weight among the
rest until none is above.  Each round is one aggregate over the sources;
two sums reach the driver.

The place in the stream is a prefix sum per source.  It is taken in two
levels (buckets of the hash order, then rows of a bucket), so a source
with a third of all rows is no single window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

Knots = Sequence[tuple[float, float]]


@dataclass(frozen=True)
class MixParams:
    """``weights`` and ``schedules`` repeat over the sources in code point
    order (null last).  ``budget``: words to take, as a share of all."""

    weights: tuple[int, ...] = (3, 1, 2)
    budget_percent: int = 150
    cap: int = 2
    schedules: tuple[Knots, ...] = (
        ((0.0, 1.5), (1.0, 0.5)),               # early in the run
        ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)),   # in the middle
        ((0.0, 0.5), (1.0, 1.5)))               # late
    seed: int = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.SPACE_WORD)), F.lit(0)
                      ).cast("long")


def row_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded 60-bit hash of the document, the same in any engine."""
    text_md5 = F.coalesce(F.md5(text.cast("binary")), F.lit(""))
    whole = F.concat(F.lit(f"{seed}|"), F.coalesce(
        doc_id.cast("string"), F.lit("")), F.lit("|"), text_md5)
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10
                  ).cast("long")


def source_targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """(source, source_size, rank, weight, target) for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = _ranked(per)
    n = len(p.weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in p.weights]),
                          (F.col("rank") % n + 1).cast("int")).cast("long")
    per = C.cut(per.withColumn("weight", weight))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * p.cap
    # 100 * target of a source that isn't capped = weight * left / weights
    capped = F.lit(False)
    seen = -1
    while True:
        r = per.agg(
            F.sum(F.when(capped, cap)).alias("used"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weights"),
            F.count(F.when(capped, 1)).alias("n")).first()
        left = p.budget_percent * total - 100 * (r["used"] or 0)
        weights = r["weights"] or 1
        if r["n"] == seen:
            break
        seen = r["n"]
        # as decimals: the comparison is exact
        capped = (F.col("weight").cast("decimal(38,0)") * F.lit(left).cast(
            "decimal(38,0)") >= cap.cast("decimal(38,0)")
            * F.lit(100 * weights).cast("decimal(38,0)"))
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(
        float(100 * weights))
    return per.withColumn("target", F.when(capped, cap.cast("double"))
                          .otherwise(share))


def _ranked(per: DataFrame) -> DataFrame:
    """Add the rank of each source by code point, null last, from 0.

    Sources are range-partitioned and numbered within a partition; one
    count per partition gives the offsets."""
    s = F.col("source")
    parts = C.cut(per.repartitionByRange(s.asc_nulls_last())
                  .withColumn("part", F.spark_partition_id()))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count("*").alias("c")).select(
        "part", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
    wp = Window.partitionBy("part").orderBy(s.asc_nulls_last())
    return (parts.withColumn("row", F.row_number().over(wp))
            .join(offsets, "part")
            .withColumn("rank", F.col("row") + F.col("before") - 1)
            .drop("row", "before", "part"))


def position(share: Column, knots: Knots) -> Column:
    """t at which the integral of the schedule has reached ``share``.

    Within a segment the weight is linear, so the integral is a parabola:
    the share left in the segment is a root away."""
    area = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
    due = share * F.lit(area[-1])
    out = F.lit(float(knots[-1][0]))
    for i in reversed(range(len(knots) - 1)):
        (t0, w0), (t1, w1) = knots[i], knots[i + 1]
        slope = (w1 - w0) / (t1 - t0)
        rest = F.greatest(due - F.lit(area[i]), F.lit(0.0))
        # w0 d + slope d^2 / 2 = rest, in the form that has no cancellation
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope),
                                 F.lit(0.0)))
        low = F.lit(w0) + root
        d = F.when(low > 0, 2 * rest / low).otherwise(F.lit(0.0))
        out = F.when(due < F.lit(area[i + 1]), F.least(
            F.lit(t0) + d, F.lit(float(t1)))).otherwise(out)
    return out


def plan_mix(docs: DataFrame, params: MixParams = MixParams(),
             id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """What the mix takes of each document: doc_id, source, size,
    source_size, target, taken, rank, place, row_key and position (where in
    the run, 0 to 1, its first pass is due; null if nothing is taken).

    ``taken`` counts words, repeats included: each source takes
    round(target) words, whole passes first, then documents in seeded hash
    order; only the last one is taken in part.  A null text has size 0; a
    null source is a source of its own, the last.  Rows that repeat a
    doc_id count each on its own.  An empty table gives an empty result.
    """
    d = C.own_columns(docs, {id_col: "doc_id", text_col: "text",
                             source_col: "source"})
    return C.result_of(lambda: _plan(d, params), docs.sparkSession, "mix")


def _plan(d: DataFrame, p: MixParams) -> DataFrame:
    sizes = C.save(d.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        word_count(F.col("text")).alias("size"),
        row_key(F.col("doc_id"), F.col("text"), p.seed).alias("row_key")),
        "mix-sizes")
    targets = C.cut(source_targets(sizes, p))
    n = C.hash_buckets(sizes.count())
    # equal keys and ids are equal rows: their order doesn't matter, and they
    # follow each other
    rows = sizes.withColumn("bucket", F.floor(
        F.shiftright("row_key", 30) * n / F.lit(2 ** 30)).cast("long"))
    rows = C.prefix_sums(rows, ["source"], "bucket", ["row_key", "doc_id"],
                         "size", "place")
    t = targets.withColumnRenamed("source", "__s")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    goal = F.round("target").cast("long")
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(goal / size)).otherwise(F.lit(0))
    rest = goal - passes * size
    part = F.least(F.greatest(rest - F.col("place"), F.lit(0)),
                   F.col("size"))
    rows = rows.withColumn(
        "taken", (passes * F.col("size") + part).cast("long")).drop("bucket")
    first = _position(F.try_divide("place", "target"), p)
    return rows.withColumn("position", F.when(F.col("taken") > 0, first))


def _position(due: Column, p: MixParams) -> Column:
    """``position`` by the schedule of the row's source (its rank)."""
    at = F.lit(None).cast("double")
    for i, knots in enumerate(p.schedules):
        at = F.when(F.col("rank") % len(p.schedules) == i,
                    position(due, knots)).otherwise(at)
    return at


KEYS = ["__key", "__id", "__src"]


def _on_keys(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on the keys, nulls equal; the columns of ``a`` and of ``b``
    beyond the keys."""
    b = b.withColumnsRenamed({k: f"{k}_b" for k in KEYS})
    cond = F.lit(True)
    for k in KEYS:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_b"))
    out = a.join(b, cond, how)
    return out.drop(*[f"{k}_b" for k in KEYS])


def mix(docs: DataFrame, params: MixParams = MixParams(),
        id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """``docs`` as the mix trains on them: a row for each begun pass over a
    document, with its training ``position`` (0 to 1), range-sorted by it.

    Documents of which nothing is taken are left out; a document's last
    pass may be in part, its row holds the whole text.  Rows equal in id,
    text and source are dealt the places of such rows in the order of a
    hash of all columns, so reruns agree.  Columns of ``docs`` stay as they
    are; the new one is named ``__position``.
    """
    p = params
    plan = plan_mix(docs, p, id_col, text_col, source_col)
    plan = plan.withColumnsRenamed(dict(zip(("row_key", "doc_id", "source"),
                                            KEYS, strict=True)))
    per_pass = F.explode(F.sequence(
        F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int")))
    passes = plan.where("taken > 0").withColumn("k", per_pass)
    due = (F.col("place") + F.col("k") * F.col("source_size")) / F.col(
        "target")
    ats = C.save(passes.withColumn("at", _position(due, p)).groupBy(
        *KEYS, "place", "size").agg(F.collect_list("at").alias("__ats")),
        "mix-passes")
    again = C.cut(plan.groupBy(*KEYS).agg(
        F.count("*").alias("rows"), F.min("place").alias("first"))
        .where("rows > 1").select(*KEYS, "first"))
    few = again.count() <= C.BROADCAST_ROWS
    again_ = F.broadcast(again) if few else again
    whole = docs.withColumns(dict(zip(KEYS, (
        row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), p.seed),
        F.col(f"`{id_col}`").cast("long"),
        F.col(f"`{source_col}`").cast("string")), strict=True)))
    once = _on_keys(ats, again_, "left_anti").drop("place", "size")
    out = _on_keys(whole, once, "inner").drop(*KEYS)
    if not again.isEmpty():
        out = out.unionByName(_repeated(
            _on_keys(whole, again_.drop("first"), "left_semi"),
            _on_keys(ats, again_, "inner")))
    return (out.withColumn("__position", F.explode("__ats")).drop("__ats")
            .repartitionByRange("__position", F.col(f"`{id_col}`"))
            .sortWithinPartitions("__position", F.col(f"`{id_col}`")))


def _repeated(rows: DataFrame, ats: DataFrame) -> DataFrame:
    """Rows that share their keys with others, each with the plan of one of
    the places of such rows.

    Rows equal in every column are one counted entry; the entries of a key
    are numbered by two-level sums and unfold to copies in stretches, so no
    key is one window or one task."""
    names = [c for c in rows.columns if c not in KEYS]
    hashed = [x for c in names for x in (F.col(f"`{c}`"),
                                         F.col(f"`{c}`").isNull())]
    entries = rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(
        F.count("*").alias("__n")).withColumn("__h", F.xxhash64(*hashed))
    entries = entries.withColumn("__bucket", F.pmod("__h", F.lit(256)))
    entries = C.prefix_sums(entries, KEYS, "__bucket", ["__h"], "__n",
                            "__earlier")
    copies = C.unfold(entries, F.col("__earlier") + 1,
                      F.col("__earlier") + F.col("__n"), "__copy").drop(
        "__n", "__h", "__bucket", "__earlier")
    # the places of equal rows are a size apart
    numbered = ats.withColumn("__copy_b", F.floor(
        (F.col("place") - F.col("first")) / F.col("size")) + 1).drop(
        "place", "first", "size")
    numbered = numbered.withColumnsRenamed({k: f"{k}_b" for k in KEYS})
    cond = F.col("__copy") == F.col("__copy_b")
    for k in KEYS:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_b"))
    return copies.join(numbered, cond).select(
        *[F.col(f"`{c}`") for c in names], "__ats")
