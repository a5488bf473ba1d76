"""Tables and loads that appear whole or not at all."""

import pytest
from pyspark.sql import functions as F

from veracity.sources import files, publish


def frames(spark, n=100):
    a = spark.range(n).select(F.col("id").alias("k"), F.lit("a").alias("s"))
    b = spark.range(n, n + 50).select(F.lit("b").alias("s"),
                                      F.col("id").cast("int").alias("k"))
    return [a, b]


def bad(spark):
    return spark.range(10).select(
        F.raise_error(F.lit("broken feed")).cast("string").alias("s"),
        F.col("id").alias("k"))


def test_columns_are_aligned_and_counted(spark, tmp_path):
    path = str(tmp_path / "t")
    out = files.append_feeds(frames(spark), path)
    assert out.count() == 150
    assert dict(out.dtypes) == {"k": "bigint", "s": "string"}
    assert spark.read.parquet(path).where("s = 'b'").count() == 50


def test_a_feed_that_fails_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    files.append_feeds(frames(spark), path)
    before = sorted(spark.read.parquet(path).collect())
    with pytest.raises(Exception, match="broken feed"):
        files.append_feeds([frames(spark, 7)[0], bad(spark)], path)
    assert sorted(spark.read.parquet(path).collect()) == before
    # and the next load works
    assert files.append_feeds(frames(spark, 3), path).count() == 53
    assert publish.names(spark, str(tmp_path)) == ["t"]


@pytest.mark.parametrize("stop", [1, 2])
def test_a_stop_between_the_renames_is_mended(spark, tmp_path, monkeypatch,
                                              stop):
    path = str(tmp_path / "t")
    files.append_feeds(frames(spark), path)
    real, done = publish.rename, []

    def stopping(s, old, new):
        done.append(new)
        if len(done) == stop:
            raise OSError("stopped")
        real(s, old, new)
    monkeypatch.setattr(publish, "rename", stopping)
    with pytest.raises(OSError):
        files.append_feeds(frames(spark, 3), path)
    monkeypatch.setattr(publish, "rename", real)
    # before the first rename the old table stands; after it the new one,
    # complete, takes its place
    want = 150 if stop == 1 else 53
    assert publish.read_published(spark, path).count() == want
    files.append_feeds(frames(spark, 4), path)
    assert publish.names(spark, str(tmp_path)) == ["t"]


def test_a_reader_comes_between_the_renames(spark, tmp_path, monkeypatch):
    """It sees the new table, and the writer ends well; a reader that comes
    while the new table is written leaves it alone."""
    path = str(tmp_path / "t")
    files.append_feeds(frames(spark), path)
    real, counts = publish.rename, []

    def reading(s, old, new):
        counts.append(publish.read_published(s, path).count())
        real(s, old, new)
        if new.endswith(".old"):
            monkeypatch.setattr(publish, "rename", real)
            counts.append(publish.read_published(s, path).count())
    monkeypatch.setattr(publish, "rename", reading)
    assert files.append_feeds(frames(spark, 3), path).count() == 53
    assert counts == [150, 53]
    assert publish.names(spark, str(tmp_path)) == ["t"]


def test_an_incomplete_new_table_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    files.append_feeds(frames(spark), path)
    publish.rename(spark, path, path + ".old")
    frames(spark, 3)[0].write.parquet(path + ".new")       # no marker
    assert publish.read_published(spark, path).count() == 150


def test_a_repeated_load_is_not_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    files.append_feeds(frames(spark), path, load_id="monday")
    first = publish.names(spark, path)
    files.append_feeds([bad(spark)], path, load_id="monday")
    assert publish.names(spark, path) == first
    assert files.append_feeds(frames(spark, 3), path, load_id="tuesday"
                              ).count() == 53


def test_lost_rows_are_noticed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    files.append_feeds(frames(spark), path)
    real = publish.write_counted
    monkeypatch.setattr(publish, "write_counted",
                        lambda *a: real(*a) + 1)
    with pytest.raises(OSError, match="rows given"):
        files.append_feeds(frames(spark, 3), path)
    assert spark.read.parquet(path).count() == 150


def test_append_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    a, b = frames(spark)
    b = b.select(F.col("k").cast("long").alias("k"), "s")
    publish.append_once(a, path, "one")
    real, done = publish.rename, []

    def stopping(s, old, new):
        done.append(new)
        if len(done) == 2:
            raise OSError("stopped")
        real(s, old, new)
    monkeypatch.setattr(publish, "rename", stopping)
    with pytest.raises(OSError):
        publish.append_once(b.repartition(4), path, "two")
    monkeypatch.setattr(publish, "rename", real)
    for _ in range(2):
        out = publish.append_once(b.repartition(4), path, "two")
        assert out.count() == 150
    assert out.select("k").distinct().count() == 150
