"""Row numbers, generated ids, first rows, folders of many files."""

import pytest
from pyspark.sql import functions as F

from veracity.operators import numbering as N
from veracity.operators import unify
from veracity.sources import files
from veracity.sources.feeds import (PERMISSIVE_MAPPINGS, STRICT_MAPPINGS,
                                    FeedMapping)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_rows_are_numbered_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "STRETCH", 100)
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            (F.col("id") % 700).cast("string")).alias("a"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2
                                                     ).alias("b"))
    got = N.number_equal_rows(df, "n")
    assert got.columns == ["a", "b", "n"]
    assert got.count() == 3000 and got.distinct().count() == 3000
    want = {(r.a, r.b): r.c for r in df.groupBy("a", "b").agg(
        F.count("*").alias("c")).collect()}
    have = {(r.a, r.b): (r.lo, r.hi, r.c) for r in got.groupBy("a", "b").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.count("*").alias("c")).collect()}
    assert have == {k: (1, c, c) for k, c in want.items()}
    assert "Window" not in _plan(got)


def test_a_hot_row_is_no_single_task(spark, monkeypatch):
    """A third of all rows equal: the shuffle carries it as one count per
    task, and the rows come out of many tasks."""
    monkeypatch.setattr(N, "STRETCH", 1000)
    df = spark.range(0, 90_000, 1, 8).select(F.when(
        F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = N.number_equal_rows(df, "n").where("a = 0").groupBy(
            F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in parts) == 30_000
    assert max(r["count"] for r in parts) < 15_000


def test_generated_ids_are_unique_and_stay(spark):
    rows = [("x", None), (None, "x"), ("x", "x")] * 3 + [(None, None)] * 4
    df = spark.createDataFrame(rows, "order_value string, location string")
    a = N.with_row_id(df, "id").collect()
    b = N.with_row_id(df.repartition(5), "id").collect()
    assert len({r.id for r in a}) == len(rows)
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_ids_only_where_a_mapping_asks(spark):
    m = next(x for x in PERMISSIVE_MAPPINGS if x.match == "taxi")
    without = spark.createDataFrame(
        [("1.5", "2024-01-01")] * 3, "fare_amount string, pickup_time string")
    out = unify.unify_permissive(without, m).collect()
    assert len({r.user_id for r in out}) == 3
    assert all(r.user_id.startswith("T") for r in out)
    with_id = without.withColumn("user_id", F.lit("u"))
    assert {r.user_id for r in unify.unify_permissive(with_id, m).collect()
            } == {"u"}
    strict = next(x for x in STRICT_MAPPINGS if x.name == "transactions")
    raw = spark.createDataFrame([("1", "c", "2024-01-01")] * 2,
                                "purchase_amount string, city string, "
                                "timestamp string")
    assert len({r.user_id for r in unify.unify_strict(raw, strict).collect()
                }) == 2
    plain = FeedMapping("p", columns={"amount": "purchase_amount"},
                        constants={"source_id": "p"})
    assert "__row_id" not in unify.map_feed(raw, plain).columns


@pytest.mark.parametrize("n", [0, 1, 5, 100, 4999, 5000, 6000])
def test_first_rows_of_any_number(spark, monkeypatch, n):
    monkeypatch.setattr(N, "MERGE_ROWS", 5)
    monkeypatch.setattr(N, "_RANGES", 7)
    df = spark.range(5000).select(
        (F.col("id") * F.col("id") % 3001 - 1000).alias("by"),
        F.col("id").alias("t")).union(spark.createDataFrame(
            [(None, 1)], "by long, t long"))
    rows = sorted((r.by, r.t) for r in df.collect() if r.by is not None)[:n]
    got = N.first_rows(df, "by", n, ["t"])
    assert sorted((r.by, r.t) for r in got.collect()) == rows
    ties = N.first_rows(df, "by", n)
    assert sorted(r.by for r in ties.collect()) == [b for b, _ in rows]


def test_rows_are_numbered_as_they_stand(spark, tmp_path):
    """Several files of several blocks each, a header in every file."""
    folder = tmp_path / "f"
    folder.mkdir()
    lines = []
    for k in range(4):
        part = [f"{k}-{i},{'x' * (i % 50)}" for i in range(1 + 2000 * k)]
        (folder / f"part-{k}.csv").write_text("\n".join(["key,pad", *part])
                                              + "\n")
        lines += part
    (folder / "part-9.csv").write_text("key,pad\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.read_csv_rows(spark, str(folder))
        blocks = spark.read.text(str(folder)).select(
            "_metadata.file_path", "_metadata.file_block_start"
        ).distinct().count()
        rows = {r.row_number: f"{r.key},{r.pad or ''}" for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert blocks > 12
    assert got.columns == ["key", "pad", "row_number"]
    assert [rows[k] for k in range(len(lines))] == lines
    assert len(rows) == len(lines)


def test_a_folder_of_many_small_files(spark, tmp_path):
    """2 000 files, three headers, two mappings: a scan per (mapping,
    header), not per file."""
    folder = tmp_path / "feeds"
    folder.mkdir()
    for k in range(2000):
        name, head, row = (
            ("taxi", "user_id,fare_amount,pickup_location,pickup_time",
             f"u{k},{k + 1},c,2024-01-01") if k % 3 == 0 else
            ("taxi", "pickup_time,fare_amount,user_id,pickup_location",
             f"2024-01-01,{k + 1},u{k},c") if k % 3 == 1 else
            ("ecommerce", 'customer_id,purchase_amount,"location",'
             "purchase_time", f'u{k},{k + 1},"a, b",2024-01-01'))
        blank = "\n" if k % 2 else ""
        (folder / f"{name}_{k:04d}.csv").write_text(f"{blank}{head}\n{row}\n")
    (folder / "empty.csv").write_text("")
    feeds = files.read_feed_directory(spark, str(folder), PERMISSIVE_MAPPINGS,
                                      file_col="file")
    assert len(feeds) == 3
    assert sorted(m.name for _, m in feeds) == ["ecommerce", "taxi", "taxi"]
    out = unify.unify_feeds([unify.unify_permissive(df, m)
                             for df, m in feeds])
    assert _plan(out).count("FileScan csv") == 3
    rows = out.collect()
    assert len(rows) == 2000
    assert {(r.user_id, r.amount) for r in rows} == {
        (f"u{k}", k + 1.0) for k in range(2000)}
    assert {r.city for r in rows} == {"c", "a, b"}
    df = feeds[0][0]
    assert df.select("file").distinct().count() == df.count()


def test_headers_are_found_without_a_sort_of_the_lines(spark, tmp_path):
    """Long files, several in a task, blank lines over a batch's end: no
    more than a line per file reaches the aggregate."""
    folder = tmp_path / "feeds"
    folder.mkdir()
    blank = {0: 0, 1: 3, 2: 25_000}
    for k in range(3):
        (folder / f"f{k}.csv").write_text(
            "\n" * blank[k] + f"id,h{k}\n" + "1,x\n" * 30_000)
    (folder / "empty.csv").write_text("\n\n")
    got = files.header_catalogue(spark, str(folder))
    assert {(r.path.rsplit("/", 1)[-1], r.header) for r in got.collect()} == {
        (f"f{k}.csv", f"id,h{k}") for k in range(3)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Sort"):] if "Sort" in plan else plan
    assert "MapInArrow" in below


def test_headers_as_a_reader_has_them():
    assert files.header_names('﻿a,"b, c",,A,d') == [
        "a0", "b, c", "_c2", "A3", "d"]


def test_load_csv_data_types_and_stamps(spark, tmp_path):
    """Inferred types and an ingestion time."""
    p = tmp_path / "x.csv"
    p.write_text("a,b,c\n1,1.5,x\n2,,y\n")
    df = files.load_csv_data(spark, str(p), as_of="2024-02-01 00:00:00")
    assert [t for _, t in df.dtypes] == ["int", "double", "string",
                                         "timestamp"]
    rows = df.collect()
    assert [(r.a, r.b, r.c) for r in rows] == [(1, 1.5, "x"), (2, None, "y")]
    assert {str(r.ingestion_timestamp) for r in rows} == {
        "2024-02-01 00:00:00"}
    given = files.load_csv_data(spark, str(p), schema="a string, b string, "
                                "c string")
    assert given.first().a == "1"
