"""Forest properties: path lengths, compiled scores, rate, determinism."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracity.operators import forest
from veracity.params import ForestParams


def test_average_path_length():
    c = forest.average_path_length([0, 1, 2, 3, 256])
    assert c[0] == 0 and c[1] == 0 and c[2] == 1.0
    assert c[3] == pytest.approx(2 * (np.log(2) + forest.EULER_GAMMA) - 4 / 3)
    assert c[4] == pytest.approx(10.2447, abs=1e-3)


def test_step_function_equals_tree_walk():
    rng = np.random.default_rng(0)
    x = rng.exponential(30, 256)
    rows = []
    for t in range(5):
        for lo, hi, d in forest.grow_tree(x, forest.hash_draw(1, t), 8):
            rows.append((t, lo, hi, d))
    import pandas as pd
    leaves = pd.DataFrame(rows, columns=["tree", "lo", "hi", "depth"])
    steps = forest.StepFunction.compile(leaves)
    probes = np.concatenate([x, rng.uniform(-10, 400, 200)])
    j = steps.interval(probes)
    for p, depth in zip(probes, steps.depths[j]):
        walk = leaves[(leaves.lo < p) & (p <= leaves.hi)].groupby("tree")["depth"].first()
        assert len(walk) == 5
        assert depth == pytest.approx(walk.mean())


def test_rate_near_contamination_on_training_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        "event_id", F.col("value").alias("amount"))
    p = ForestParams(key_cols=("event_id",), sample_fraction=1.0)
    m = forest.fit_isolation_forest(df, p)
    rate = m.transform(df).agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
    assert 0.03 <= rate <= 0.07


def test_same_model_under_any_partitioning(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        "event_id", F.col("value").alias("amount"))
    p = ForestParams(key_cols=("event_id",))
    a = forest.fit_isolation_forest(df, p)
    b = forest.fit_isolation_forest(df.repartition(7), p)
    assert a.threshold == b.threshold
    assert np.array_equal(a.steps.breaks, b.steps.breaks)


def test_model_roundtrip_and_missing(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "event_id", F.col("value").alias("amount"))
    m = forest.fit_isolation_forest(df, ForestParams(key_cols=("event_id",)))
    m.save(spark, str(tmp_path / "model"))
    m2 = forest.IsolationForestModel.load(spark, str(tmp_path / "model"))
    assert m2.threshold == m.threshold
    assert np.allclose(m2.scores, m.scores)
    with pytest.raises(FileNotFoundError):
        forest.IsolationForestModel.load(spark, str(tmp_path / "absent"))


def _jobs(spark, run):
    """(result, number of Spark jobs that it took)"""
    import uuid
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(
        group))


def test_scoring_stays_in_the_jvm(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "event_id", F.col("value").alias("amount"))
    m = forest.fit_isolation_forest(df, ForestParams(key_cols=("event_id",)))
    plan = m.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_jvm_scores_equal_the_step_function(spark):
    """Values on, beside and between the breakpoints; zeros of both signs,
    infinities, null and NaN (scored as the fill)."""
    import pandas as pd
    rng = np.random.default_rng(4)
    x = np.r_[rng.exponential(30, 200), np.zeros(56), -rng.random(20)]
    rows = [(t, lo, hi, d) for t in range(7) for lo, hi, d in
            forest.grow_tree(x, forest.hash_draw(5, t), 8)]
    leaves = pd.DataFrame(rows, columns=["tree", "lo", "hi", "depth"])
    model = forest.IsolationForestModel(leaves, 256, 256, 0.5, 0.0)
    b = model.steps.breaks
    probes = np.r_[b, np.nextafter(b, np.inf), np.nextafter(b, -np.inf),
                   0.0, -0.0, np.inf, -np.inf, 1e308, -1e308]
    df = spark.createDataFrame(
        [(k, float(v)) for k, v in enumerate(probes)]
        + [(-1, None), (-2, float("nan"))],
        "k long, amount double")
    got = {r["k"]: r for r in model.transform(df, keep_score=True).collect()}
    want = model.scores[model.steps.interval(probes)]
    assert [got[k]["anomaly_score"] for k in range(len(probes))] == list(want)
    fill = model.scores[model.steps.interval(np.array([0.0]))][0]
    assert {got[k]["anomaly_score"] for k in (-1, -2)} == {fill}
    assert list(model.transform(df).columns) == [
        "k", "amount", "anomaly_severity", "is_anomaly"]


def test_fit_and_median_take_few_jobs(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select(
        "event_id", F.col("value").alias("amount"))
    _, fit = _jobs(spark, lambda: forest.fit_isolation_forest(
        df, ForestParams(key_cols=("event_id",))))
    assert fit <= 12
    med, jobs = _jobs(spark, lambda: forest.sample_median(df, "amount"))
    assert jobs <= 4
    assert med == df.agg(F.median("amount")).first()[0]


def test_random_trees_converge_to_closed_form():
    """Mean depth of many unbounded random trees -> the exact expectation."""
    rng = np.random.default_rng(3)
    a = np.unique(np.round(rng.exponential(20, 40), 2))
    probes = np.concatenate([a[[0, 5, 17, -1]], [(a[3] + a[4]) / 2, a[-1] + 9]])
    total = np.zeros(len(probes))
    trees = 3000
    for t in range(trees):
        leaves = forest.grow_tree(a, forest.hash_draw(9, t), 10_000)
        for lo, hi, d in leaves:
            total += np.where((lo < probes) & (probes <= hi), d, 0.0)
    approx = total / trees
    exact = forest.expected_depth_exact(probes, a)
    assert np.allclose(approx, exact, atol=0.15)


@pytest.mark.parametrize("n", [0, 1, 20, 1500])
def test_small_frames_fit_and_score(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 37).cast("double")
                               .alias("amount"))
    out = forest.detect_anomalies(df, 0.02)
    assert out.count() == n
    if n <= 1:
        assert out.where("is_anomaly").count() == 0


def test_median_is_exact(spark):
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=30_001), rng.integers(0, 9, 20_000) * 1.5,
              np.r_[np.zeros(9_000), rng.normal(size=9_001)], np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        assert forest.sample_median(df) == np.median(x)
    assert forest.sample_median(df.where("x < 0")) is None


def test_median_narrows_and_widens(spark, monkeypatch):
    """Brackets of more rows than are counted at once, and one that misses
    the middle ranks."""
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=40_000), np.full(15_001, 0.25), np.nan, np.nan]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    want = np.nanmedian(x)
    monkeypatch.setattr(forest, "BRACKET_ROWS", 10)
    assert forest.sample_median(df) == want
    monkeypatch.setattr(forest, "BRACKET_ROWS", 200_000)
    m = forest.middle_of(df)
    assert (m.rows, m.values) == (len(x), len(x) - 2)
    missed = forest.Middle(m.rows, m.values, 2.0, 3.0)
    assert forest.sample_median(df, middle=missed) == want


def _two_models(spark):
    df = spark.range(600).select("id", F.col("id").cast("double")
                                 .alias("amount"))
    return [forest.fit_isolation_forest(df, ForestParams(
        key_cols=("id",), seed=s)) for s in (1, 2)]


@pytest.mark.parametrize("stop_at", ["leaves", "meta", "pointer"])
def test_a_stopped_save_leaves_the_old_model(spark, tmp_path, monkeypatch,
                                             stop_at):
    """A stop before, between and after the two tables."""
    from pyspark.sql.readwriter import DataFrameWriter
    from veracity.sources import publish
    old, new = _two_models(spark)
    path = str(tmp_path / "m")
    old.save(spark, path)
    write, turn = DataFrameWriter.parquet, publish.write_json

    def stopping(self, to, *a, **kw):
        if to.endswith(stop_at):
            raise OSError("stopped")
        return write(self, to, *a, **kw)

    def no_turn(*a):
        raise OSError("stopped")
    monkeypatch.setattr(DataFrameWriter, "parquet", stopping)
    if stop_at == "pointer":
        monkeypatch.setattr(publish, "write_json", no_turn)
    with pytest.raises(OSError):
        new.save(spark, path)
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    monkeypatch.setattr(publish, "write_json", turn)
    got = forest.IsolationForestModel.load(spark, path)
    assert got.threshold == old.threshold
    assert got.leaves.equals(old.leaves)
    assert bool(publish.remove_orphans(spark, path)) == (stop_at != "leaves")
    new.save(spark, path)
    got = forest.IsolationForestModel.load(spark, path)
    assert got.leaves.equals(new.leaves) and got.threshold == new.threshold
    # a third save removes the first generation, never the one before it
    old.save(spark, path)
    assert len([n for n in publish.names(spark, path)
                if n.startswith("gen-")]) == 2


def test_leaves_of_another_model_are_refused(spark, tmp_path):
    import shutil
    from veracity.sources import publish
    a, b = _two_models(spark)
    for name, m in (("a", a), ("b", b)):
        m.save(spark, str(tmp_path / name))
    one, two = (publish.current_generation(spark, str(tmp_path / n))[0]
                for n in "ab")
    shutil.rmtree(f"{one}/leaves")
    shutil.copytree(f"{two}/leaves", f"{one}/leaves")
    with pytest.raises(ValueError, match="not the leaves"):
        forest.IsolationForestModel.load(spark, str(tmp_path / "a"))


def test_damaged_model_is_left_untouched(spark, tmp_path):
    from veracity.sources import publish
    df = spark.range(300).select("id", F.col("id").cast("double")
                                 .alias("amount"))
    path = str(tmp_path / "m")
    forest.train_initial_model(df, path, ForestParams(key_cols=("id",)))
    leaves = tmp_path / "m" / publish.current_generation(
        spark, path)[0].rsplit("/", 1)[1] / "leaves"
    for f in leaves.glob("part-*"):
        f.write_bytes(b"no parquet")
    for f in leaves.glob(".part-*.crc"):
        f.unlink()
    with pytest.raises(Exception) as e:
        forest.train_initial_model(df, path)
    assert not isinstance(e.value, FileNotFoundError)
    assert [f.read_bytes() for f in leaves.glob("part-*")] == [b"no parquet"]
