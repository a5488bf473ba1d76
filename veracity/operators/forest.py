"""An isolation forest trained and applied on Spark.

Algorithm: Liu, Ting and Zhou, "Isolation Forest" (ICDM 2008).  Each tree
is grown on at most ``max_samples`` points with uniform random cuts, to a
depth cap of ceil(log2(max_samples)); a leaf of n points adds c(n), the
average path length of an unsuccessful search in a binary search tree.
score(x) = 2^(-mean depth / c(max_samples)); the flag threshold is the
(1 - contamination) quantile of the training scores.

Everything random is a hash, so a fit repeats on any cluster and in SQL:

* **Training sample** (A1): rows whose key hash is below the fraction, and
  at least the ``max_samples`` smallest hashes, so that a small table
  trains on what it has.
* **Per-tree samples**: an integer mix of the row's key hash and the tree
  number orders the rows anew for each tree; the tree takes the first
  ``max_samples``.  Only rows below a cut that leaves a few times as many
  are copied per tree; the cut is widened until every tree is full.
* **Cuts** (A3): the cut of a node is lo + u (hi - lo), u from the md5 of
  (seed, tree, node).  ``groupBy("tree").applyInPandas`` grows the trees
  in parallel, one bounded group per tree.  The model is a table of leaves
  (tree, lo, hi, depth): the leaf holds the values in (lo, hi].
* **One feature => a step function**: all trees together are constant
  between consecutive cut points, so the forest compiles into a sorted
  array of at most trees x max_samples breakpoints with one score each.
  Scoring (A4/A5/A11) is a binary search in the JVM (``Bucketizer``) and
  a join with the broadcast scores, one row per interval; no Python.
* **Median** (A2): one quantile sketch brackets both middle ranks, one
  count of the bracket's values gives them exactly.
* **Threshold**: scores take one value per interval, so the training
  score distribution is a histogram of at most (breakpoints + 1) counts
  (a partial aggregate), from which the quantile is exact.
* **Storage** (S16): a versioned folder; a model is replaced by turning
  one pointer, and its leaves are checked against count and digest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import key_hash
from ..params import ForestParams
from ..session import delete_path, scratch_path
from ..sources import publish

EULER_GAMMA = 0.5772156649015329
# Digits kept of depths and scores, so that sums in another order agree.
DEPTH_PLACES, SCORE_PLACES = 9, 12


def average_path_length(n) -> np.ndarray:
    """c(n): 0 for n <= 1, 1 for n = 2, else 2 H(n-1) - 2 (n-1) / n."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    m = n[big]
    out[big] = 2.0 * (np.log(m - 1.0) + EULER_GAMMA) - 2.0 * (m - 1.0) / m
    return out


def hash_draw(seed: int, tree: int):
    """node number -> u in [0, 1), from an md5 (children of n: 2n, 2n + 1)."""
    def draw(node: int) -> float:
        text = f"{seed}|{tree}|{node}".encode()
        return int(hashlib.md5(text).hexdigest()[:8], 16) / 2.0 ** 32
    return draw


def grow_tree(values: np.ndarray, draw, max_depth: int
              ) -> list[tuple[float, float, float]]:
    """Leaves (lo, hi, path length) of one isolation tree over 1-D values.

    A node splits at a uniform cut in [min, max); values <= cut go left.
    Growth stops at the depth cap, at one point, or at equal values.
    """
    v = np.sort(np.asarray(values, dtype=float))
    leaves = []
    stack = [(v, -math.inf, math.inf, 0, 1)]
    while stack:
        x, lo, hi, d, node = stack.pop()
        n = len(x)
        if d >= max_depth or n <= 1 or x[0] == x[-1]:
            leaves.append((lo, hi, d + float(average_path_length([n])[0])))
            continue
        cut = float(x[0] + draw(node) * (x[-1] - x[0]))
        if cut >= x[-1]:
            cut = float(x[0])
        k = int(np.searchsorted(x, cut, side="right"))
        stack.append((x[:k], lo, cut, d + 1, 2 * node))
        stack.append((x[k:], cut, hi, d + 1, 2 * node + 1))
    return leaves


@dataclass
class StepFunction:
    """The forest compiled: score of each interval between breakpoints."""

    breaks: np.ndarray      # sorted cut points b_0 < ... < b_(m-1)
    depths: np.ndarray      # mean path length of the m + 1 intervals

    @classmethod
    def compile(cls, leaves: pd.DataFrame) -> "StepFunction":
        """Interval j is (b_(j-1), b_j]; the last one is (b_(m-1), inf)."""
        his = leaves["hi"].to_numpy(dtype=float)
        breaks = np.unique(his[np.isfinite(his)])
        probes = np.append(breaks, math.inf)
        total = np.zeros(len(probes))
        trees = leaves.sort_values(["tree", "hi"]).groupby("tree")
        for _, t in trees:
            h = t["hi"].to_numpy(dtype=float)
            total += t["depth"].to_numpy(dtype=float)[
                np.searchsorted(h, probes, side="left")]
        return cls(breaks, np.round(total / max(1, trees.ngroups),
                                    DEPTH_PLACES))

    def interval(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.breaks, x, side="left")


@dataclass
class IsolationForestModel:
    """Trained forest: leaves table, compiled scores, threshold."""

    leaves: pd.DataFrame
    sample_size: int
    max_samples: int
    threshold: float
    median: float
    params: ForestParams = field(default_factory=ForestParams)

    def __post_init__(self):
        self.steps = StepFunction.compile(self.leaves)
        self.scores = np.round(np.power(
            2.0, -self.steps.depths /
            float(average_path_length([self.max_samples])[0] or 1.0)),
            SCORE_PLACES)

    # -------------------------------------------------------------- scoring
    def with_interval(self, df: DataFrame, x: Column, fill: float,
                      out: str) -> DataFrame:
        """Add the number of the interval that ``x`` lies in; a null or NaN
        counts as ``fill``.  The intervals are closed on the right, the
        splits of ``Bucketizer`` on the left: it searches the negated
        value among the negated breakpoints and counts from the other end.
        """
        m = len(self.steps.breaks)
        if not m:
            return df.withColumn(out, F.lit(0))
        x = x.cast("double")
        x = F.when(x.isNull() | F.isnan(x), F.lit(float(fill))).otherwise(x)
        # adding 0.0 turns -0.0 into 0.0
        splits = [-math.inf, *(-self.steps.breaks[::-1] + 0.0).tolist(),
                  math.inf]
        found = Bucketizer(splits=splits, inputCol=out, outputCol=f"{out}_b"
                           ).transform(df.withColumn(out, -x + F.lit(0.0)))
        return found.withColumn(out, (F.lit(m) - F.col(f"{out}_b")).cast(
            "int")).drop(f"{out}_b")

    def scores_frame(self, spark: SparkSession) -> DataFrame:
        """(__forest_interval, anomaly_score), a row per interval: at most
        trees x max_samples + 1, so it is always small enough to send."""
        return spark.createDataFrame(pd.DataFrame({
            "__forest_interval": np.arange(len(self.scores), dtype="int32"),
            "anomaly_score": self.scores}),
            "__forest_interval int, anomaly_score double")

    def transform(self, df: DataFrame, feature_col: str | None = None,
                  fill: float | None = None, keep_score: bool = False
                  ) -> DataFrame:
        """Add ``is_anomaly`` and ``anomaly_severity``.

        severity = score - threshold (positive = anomalous), the negated
        decision value; a null feature is scored as ``fill`` (0.0).  A
        search and a broadcast join in the JVM, on streams too.
        """
        feat = feature_col or self.params.feature_col
        fill = self.params.score_fill if fill is None else fill
        placed = self.with_interval(df, F.col(feat), fill,
                                    "__forest_interval")
        scores = self.scores_frame(df.sparkSession)
        scored = placed.join(F.broadcast(scores), "__forest_interval", "left")
        out = scored.select(
            *[F.col(f"`{c}`") for c in df.columns if c != "anomaly_score"],
            "anomaly_score",
            (F.col("anomaly_score") - F.lit(self.threshold)).alias(
                "anomaly_severity"))
        out = out.withColumn("is_anomaly", F.col("anomaly_severity") > 0)
        return out if keep_score else out.drop("anomaly_score")

    # ------------------------------------------------------------ model I/O
    def leaves_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.leaves[["tree", "lo", "hi", "depth"]],
            "tree long, lo double, hi double, depth double")

    def save(self, spark: SparkSession, path: str) -> None:
        """The model as a new generation of a versioned folder (two
        small Parquet tables, no pickle).  Whoever loads meanwhile, or
        after a stop in between, gets the model before, whole."""
        p = self.params
        meta = pd.DataFrame([{
            "sample_size": int(self.sample_size),
            "max_samples": int(self.max_samples),
            "threshold": float(self.threshold), "median": float(self.median),
            "contamination": float(p.contamination),
            "feature_col": p.feature_col, "score_fill": float(p.score_fill),
            "n_trees": int(p.n_trees), "tree_samples": int(p.max_samples),
            "seed": int(p.seed), "sample_fraction": float(p.sample_fraction),
            "n_leaves": len(self.leaves),
            "leaves_sha256": leaves_digest(self.leaves)}])

        def write(folder: str) -> None:
            self.leaves_frame(spark).coalesce(1).write.parquet(
                f"{folder}/leaves")
            spark.createDataFrame(meta).coalesce(1).write.parquet(
                f"{folder}/meta")
        publish.publish_generation(spark, path, write)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForestModel":
        """Read the saved model in force.  A path without one raises
        FileNotFoundError; leaves that aren't those that were saved raise
        ValueError, unreadable files what Spark raises."""
        found = publish.current_generation(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        meta = spark.read.parquet(f"{found[0]}/meta").first()
        leaves = spark.read.parquet(f"{found[0]}/leaves").toPandas()
        if (len(leaves) != meta["n_leaves"]
                or leaves_digest(leaves) != meta["leaves_sha256"]):
            raise ValueError(f"{found[0]}: not the leaves that were saved")
        params = ForestParams(
            n_trees=meta["n_trees"], max_samples=meta["tree_samples"],
            contamination=meta["contamination"], seed=meta["seed"],
            sample_fraction=meta["sample_fraction"],
            feature_col=meta["feature_col"], score_fill=meta["score_fill"])
        return cls(leaves, int(meta["sample_size"]), int(meta["max_samples"]),
                   float(meta["threshold"]), float(meta["median"]), params)


def leaves_digest(leaves: pd.DataFrame) -> str:
    """A digest of the leaves, whatever their order."""
    rows = np.array(sorted(leaves[["tree", "lo", "hi", "depth"]].itertuples(
        index=False, name=None)), dtype="<f8")
    return hashlib.sha256(rows.tobytes()).hexdigest()


# ------------------------------------------------------------------ fitting
def training_rows(df: DataFrame, params: ForestParams) -> DataFrame:
    """(x, h): the feature, NaN as null, and the row's 32-bit key hash.
    Without key columns the whole row is hashed; equal rows are then in or
    out together."""
    keys = list(params.key_cols or df.columns)
    x = F.col(params.feature_col).cast("double")
    return df.select(F.when(~F.isnan(x), x).alias("x"),
                     key_hash(keys, params.seed, "md5").alias("h"))


@contextmanager
def training_sample(df: DataFrame, params: ForestParams
                    ) -> Iterator[tuple[DataFrame, "Middle"]]:
    """A1: the training rows with h / 2^32 < fraction, or the
    ``max_samples`` smallest hashes if those are more, as a table that
    lasts as long as the block; and where its middle lies."""
    spark = df.sparkSession
    rows = training_rows(df, params)
    cut = int(round(float(params.sample_fraction) * 2 ** 32))
    paths = []

    def stored(part: DataFrame) -> tuple[DataFrame, Middle]:
        paths.append(scratch_path(spark, "forest-sample"))
        part.write.parquet(paths[-1])
        table = spark.read.schema("x double, h long").parquet(paths[-1])
        return table, middle_of(table)
    try:
        sample, middle = stored(rows.where(F.col("h") < cut))
        if middle.rows < params.max_samples:
            sample, middle = stored(rows.orderBy("h", "x").limit(
                params.max_samples))
        yield sample, middle
    finally:
        for path in paths:
            delete_path(spark, path)


# A sketch of this size misses a rank by less than SKETCH_ERROR of all rows
# (almost always; the count that follows tells if it didn't).
SKETCH_SIZE, SKETCH_ERROR = 8192, 0.002
# Values of a bracket that are counted one by one.
BRACKET_ROWS = 200_000


@dataclass
class Middle:
    """A bracket that should hold the middle ranks of a column."""

    rows: int               # all rows
    values: int             # those with a value
    low: float | None
    high: float | None


def _value(col: str) -> Column:
    """The column as a double; NaN is no value."""
    x = F.col(col).cast("double")
    return F.when(~F.isnan(x), x).alias("x")


def _bracket(n: Column, lo: Column, hi: Column) -> list[Column]:
    """Aggregates: the sketch's values a little below and above two ranks
    (as shares of n values)."""
    sketch = F.kll_sketch_agg_double("x", F.lit(SKETCH_SIZE))
    return [F.when(n > 0, F.kll_sketch_get_quantile_double(
        sketch, F.greatest(F.lit(0.0), lo - SKETCH_ERROR))).alias("low"),
        F.when(n > 0, F.kll_sketch_get_quantile_double(
            sketch, F.least(F.lit(1.0), hi + SKETCH_ERROR))).alias("high")]


def middle_of(rows: DataFrame, col: str = "x") -> Middle:
    """One aggregate: counts, and a sketch's bracket of the middle."""
    n = F.count("x")
    r = rows.select(_value(col)).agg(
        F.count(F.lit(1)).alias("rows"), n.alias("values"),
        *_bracket(n, F.lit(0.5), F.lit(0.5))).first()
    return Middle(r["rows"], r["values"], r["low"], r["high"])


def sample_median(sample: DataFrame, col: str = "x",
                  middle: Middle | None = None) -> float | None:
    """A2: the exact median of a column's values.

    The bracket's values are counted one by one, with the rows on either
    side: two aggregates altogether.  Where the bracket holds very many
    rows, a sketch of its inside narrows it first, by some hundred times
    each; where the ranks aren't inside, it is widened."""
    m = middle or middle_of(sample, col)
    if not m.values:
        return None
    x = F.col("x")
    rows = sample.select(_value(col)).where(x.isNotNull())
    first, last = (m.values - 1) // 2, m.values // 2
    low, high, inside = m.low, m.high, 2 * SKETCH_ERROR * m.values

    def parted(lo, hi):
        return F.when(x < lo, -1).when(x > hi, 1).otherwise(0)
    while True:
        side = parted(low, high)
        if inside > BRACKET_ROWS:
            r = rows.agg(F.count(F.when(side == -1, 1)).alias("below"),
                         F.count(F.when(side == 0, 1)).alias("n")).first()
            below, n = r["below"], r["n"]
            if below <= first and last < below + n:
                r = rows.where(side == 0).agg(F.count("x").alias("n"), *_bracket(
                    F.count("x"), F.lit((first - below) / n),
                    F.lit((last - below) / n))).first()
                smaller = (r["low"], r["high"]) != (low, high)
                low, high = r["low"], r["high"]
                inside = 2 * SKETCH_ERROR * n if smaller else 0
                continue
        counted = rows.groupBy(side.alias("side"), F.when(
            side == 0, x).alias("x")).agg(F.count("*").alias("n")).collect()
        at = sum(r["n"] for r in counted if r["side"] == -1)
        found = []
        for r in sorted((r for r in counted if r["side"] == 0),
                        key=lambda r: r["x"]):
            found += [r["x"] for k in (first, last) if at <= k < at + r["n"]]
            at += r["n"]
        if len(found) == 2:
            lo, hi = found
            return float(lo + (hi - lo) / 2 if hi != lo else lo)
        low, high, inside = -math.inf, math.inf, m.values


# --- fixed values of the tree mix, repeated by the oracle ---
_MIX = (2147483629, 7919, 2147483587, 104729, 4294967291)
# --- end of fixed values ---


def tree_hash(h: Column, tree: Column) -> Column:
    """The row's place in the order of a tree: 0 .. 2^32 - 6."""
    m1, a1, m2, a2, m = _MIX
    return ((h % m1 + tree * a1) * (h % m2 + tree * a2)) % m


def _grow_all(sample: DataFrame, n: int, psi: int, params: ForestParams
              ) -> pd.DataFrame:
    """The leaves of all trees, each grown on ``psi`` points: a bounded
    group per tree, in one query.  Only rows below a cut are copied per
    tree; should a tree get too few, the cut is widened."""
    trees = F.sequence(F.lit(0).cast("long"),
                       F.lit(params.n_trees - 1).cast("long"))
    w = Window.partitionBy("tree").orderBy("th", "h", "x")
    depth_cap = int(math.ceil(math.log2(max(psi, 2))))
    seed = int(params.seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        leaves = grow_tree(pdf["x"].to_numpy(), hash_draw(seed, tree),
                           depth_cap)
        return pd.DataFrame({"tree": tree,
                             "lo": [a for a, _, _ in leaves],
                             "hi": [b for _, b, _ in leaves],
                             "depth": [d for _, _, d in leaves],
                             "points": len(pdf)})

    share = min(1.0, 4.0 * psi / n)
    while True:
        limit = int(share * _MIX[-1])
        near = F.filter(trees, lambda t: tree_hash(F.col("h"), t) <= limit)
        rows = (sample.select("h", "x", F.explode(near).alias("tree"))
                .withColumn("th", tree_hash(F.col("h"), F.col("tree")))
                .withColumn("r", F.row_number().over(w))
                .where(F.col("r") <= psi).select("tree", "x"))
        # at most one leaf per sample point
        leaves = rows.groupBy("tree").applyInPandas(
            grow, "tree long, lo double, hi double, depth double, "
            "points long").toPandas()
        full = leaves.groupby("tree")["points"].first()
        if share >= 1.0 or (len(full) == params.n_trees
                            and (full == psi).all()):
            return leaves[["tree", "lo", "hi", "depth"]]
        share = min(1.0, 4 * share)


def _quantile_from_histogram(levels: np.ndarray, counts: np.ndarray,
                             q: float) -> float:
    """Linear-interpolated quantile of a multiset given as (value, count)."""
    order = np.argsort(levels)
    levels, counts = levels[order], counts[order]
    cum = np.cumsum(counts)
    n = int(cum[-1])
    pos = q * (n - 1)
    lo_i, hi_i = int(math.floor(pos)), int(math.ceil(pos))
    v_lo = levels[np.searchsorted(cum, lo_i, side="right")]
    v_hi = levels[np.searchsorted(cum, hi_i, side="right")]
    return float(v_lo + (v_hi - v_lo) * (pos - lo_i))


def fit_isolation_forest(df: DataFrame, params: ForestParams | None = None
                         ) -> IsolationForestModel:
    """Fit on a hash sample of ``df``; training nulls take the
    sample median (scoring fills 0.0, as the reference does)."""
    p = params or ForestParams()
    with training_sample(df, p) as (sample, middle):
        n = middle.rows
        if n == 0:      # nothing to learn: one leaf, and nothing above it
            leaf = pd.DataFrame([(0, -math.inf, math.inf, 0.0)],
                                columns=["tree", "lo", "hi", "depth"])
            return IsolationForestModel(leaf, 0, 0, 1.0, 0.0, p)
        median = sample_median(sample, middle=middle) or 0.0
        filled = sample.withColumn("x", F.coalesce("x", F.lit(median)))
        psi = min(int(p.max_samples), n)
        leaves = _grow_all(filled, n, psi, p)
        model = IsolationForestModel(leaves, n, psi, 0.0, median, p)
        hist = (model.with_interval(filled, F.col("x"), median, "j")
                .groupBy("j").agg(F.count(F.lit(1)).alias("n")).toPandas())
    levels = model.scores[hist["j"].to_numpy()]
    model.threshold = _quantile_from_histogram(
        levels, hist["n"].to_numpy(), 1.0 - float(p.contamination))
    return model


def detect_anomalies(df: DataFrame, sample_fraction: float = 0.1,
                     params: ForestParams | None = None,
                     keep_score: bool = False) -> DataFrame:
    """Fit on a sample of ``df`` and flag every row of ``df``."""
    p = params or ForestParams(sample_fraction=sample_fraction)
    return fit_isolation_forest(df, p).transform(df, keep_score=keep_score)


def train_model(df: DataFrame, output_path: str | None = None,
                sample_fraction: float = 0.1, contamination: float = 0.05,
                params: ForestParams | None = None) -> IsolationForestModel:
    """Fit on history and save when a path is given."""
    p = params or ForestParams(sample_fraction=sample_fraction,
                               contamination=contamination)
    model = fit_isolation_forest(df, p)
    if output_path:
        model.save(df.sparkSession, output_path)
    return model


def train_initial_model(df: DataFrame, model_path: str,
                        params: ForestParams | None = None
                        ) -> IsolationForestModel:
    """Load the model at ``model_path``; train and save it if absent."""
    spark = df.sparkSession
    try:
        return IsolationForestModel.load(spark, model_path)
    except FileNotFoundError:
        return train_model(df, model_path, params=params)


def detect_anomalies_streaming(df: DataFrame, model: IsolationForestModel
                               | str) -> DataFrame:
    """Score a (streaming) frame with a saved model, no fitting."""
    if isinstance(model, str):
        model = IsolationForestModel.load(df.sparkSession, model)
    return model.transform(df)


# ------------------------------------------------- closed form (exact check)
def expected_depth_exact(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Expected isolation depth over infinitely many fully grown trees.

    ``a``: the distinct sample values, sorted.  A point equal to a_i:
    sum over gaps j of g_j / (a_(j+1) - a_i) (gaps right of it) or
    g_j / (a_i - a_j) (gaps left of it).  A point inside gap k, L and R
    away from its ends: 1 + sum over the other gaps of
    g / (L + R + M + g) * (1 + L / (M + g)) (right side, M from a_(k+1))
    or (1 + R / (M + g)) (left side, M from a_k).  Points outside the
    sample range take the depth of the nearest end point.
    """
    a = np.asarray(a, dtype=float)
    x = np.asarray(x, dtype=float)
    n = len(a)
    out = np.zeros(len(x))
    if n < 2:
        return out
    lo, hi = a[:-1], a[1:]
    g = hi - lo
    xc = np.clip(x, a[0], a[-1])
    idx = np.searchsorted(a, xc, side="left")
    ins = a[np.minimum(idx, n - 1)] == xc
    if ins.any():
        X = xc[ins][:, None]
        right = lo[None, :] >= X
        out[ins] = np.where(right, g / np.where(right, hi - X, 1.0),
                            g / np.where(right, 1.0, X - lo)).sum(axis=1)
    if (~ins).any():
        Y = xc[~ins][:, None]
        k = idx[~ins] - 1
        ak, ak1 = a[k][:, None], a[k + 1][:, None]
        L, R = Y - ak, ak1 - Y
        right = lo[None, :] >= ak1
        left = hi[None, :] <= ak
        Mr = np.where(right, lo[None, :] - ak1, 0.0)
        Ml = np.where(left, ak - hi[None, :], 0.0)
        tr = g / (L + R + Mr + g) * (1.0 + L / (Mr + g))
        tl = g / (L + R + Ml + g) * (1.0 + R / (Ml + g))
        out[~ins] = 1.0 + np.where(right, tr, 0.0).sum(axis=1) + \
            np.where(left, tl, 0.0).sum(axis=1)
    return out


def exact_scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """2^(-expected depth / c(n)) of ``x`` for the sample ``a``."""
    c_n = float(average_path_length([len(a)])[0]) or 1.0
    return np.power(2.0, -expected_depth_exact(x, a) / c_n)


def exact_isolation_scores(values: DataFrame, sample: np.ndarray,
                           col: str = "x") -> DataFrame:
    """Add ``depth`` and ``score`` = 2^(-depth / c(n)) to ``values``,
    scored in Arrow batches against the broadcast (bounded) sample."""
    spark = values.sparkSession
    a = np.unique(np.asarray(sample, dtype=float))
    c_n = float(average_path_length([len(a)])[0]) or 1.0
    bc = spark.sparkContext.broadcast(a)

    @F.pandas_udf("double")
    def depth(x: pd.Series) -> pd.Series:
        return pd.Series(expected_depth_exact(x.to_numpy(dtype=float),
                                              bc.value))

    out = values.withColumn("depth", depth(F.col(col).cast("double")))
    return out.withColumn("score", F.pow(F.lit(2.0), -F.col("depth") / c_n))
