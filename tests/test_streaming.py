"""Streaming: checkpoint recovery, late data, sinks."""

import os
import subprocess
import sys

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from veracity.operators.quality import compute_quality_metrics
from veracity.params import QualityParams
from veracity.streaming.sinks import create_output_sink
from veracity.streaming.state import exact_stream_reputation, rocksdb_state


def test_restart_resumes_without_loss_or_duplicates(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.where("event_id < 500").write.parquet(src + "/part1")
    schema = ev.schema

    def run():
        s = (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
             .parquet(src))
        q = create_output_sink(
            compute_quality_metrics(s.withColumnRenamed("value", "purchase_amount")
                                    .withColumnRenamed("ts", "timestamp"),
                                    QualityParams.streaming(), "2024-02-01"),
            "parquet", out, ckpt, available_now=True)
        q.awaitTermination()

    run()
    ev.where("event_id >= 500").write.parquet(src + "/part2")
    run()                                   # restart from the checkpoint
    got = spark.read.parquet(out)
    assert got.count() == ev.count()
    assert got.select("event_id").distinct().count() == ev.count()


def test_unknown_sink_format(spark):
    df = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        create_output_sink(df, "jdbc")


def test_exact_mode_drops_late_rows(spark, tmp_path):
    import datetime as dt
    rows1 = [("a", dt.datetime(2024, 1, 1, 12, 0, s), False) for s in range(3)]
    rows1 += [("a", dt.datetime(2024, 1, 1, 13, 0, 0), True)]
    late = [("a", dt.datetime(2024, 1, 1, 12, 30, 0), True)]   # behind watermark
    src = str(tmp_path / "src")
    schema = "source_id string, timestamp timestamp, is_anomaly boolean"
    spark.createDataFrame(rows1, schema).coalesce(1).write.parquet(src + "/a")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        s = (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", 1).parquet(src)
             .withWatermark("timestamp", "10 minutes"))
        with rocksdb_state(spark):
            create_output_sink(exact_stream_reputation(s, 3600), "parquet",
                               out, ckpt, available_now=True
                               ).awaitTermination()

    run()
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(src + "/b")
    run()
    got = spark.read.parquet(out)
    # the 12:00 rows are closed and emitted once; the late row never shows
    assert got.where(F.col("timestamp") == dt.datetime(2024, 1, 1, 12, 30)).count() == 0
    assert got.count() == 3


def test_stateful_restart_between_batches(spark, tmp_path):
    """Half of the files, a stop, the other half: as in one run."""
    from veracity.plans import catalog_stream as S
    from veracity.streaming.sinks import create_output_sink
    sf = "/root/testdata/sf0.001"
    one = S.q_stream_sliding_batches(spark, sf)
    folder = str(tmp_path / "parts")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for parts in (range(3), range(3, S.PARTS + 1)):
        S.write_event_parts(spark, sf, folder, parts)
        q = create_output_sink(
            S.sliding_columns(S.events_stream(spark, sf, folder)), "parquet",
            out, ckpt, "append", available_now=True)
        q.awaitTermination()
    two = spark.read.schema(one.schema).parquet(out)
    assert sorted(map(repr, two.collect())) == sorted(
        map(repr, one.collect()))
    keys = [r.row_key for r in two.collect()]
    assert len(keys) == len(set(keys)) < 1000


# --- ST4: settings of a checkpoint's state -----------------------------------

def _pipeline(spark, tmp_path, folder, name, **kw):
    from veracity.plans import catalog_stream as S
    from veracity.plans import testdata as td
    from veracity.streaming.job import (StreamingPipelineConfig,
                                        create_streaming_pipeline)
    cfg = StreamingPipelineConfig(
        output_path=str(tmp_path / f"{name}-out"),
        checkpoint_dir=str(tmp_path / f"{name}-ckpt"),
        include_intermediate=True, **kw)
    create_streaming_pipeline(
        spark, cfg, model=S.stream_flags,
        source=S.events_stream(spark, "/root/testdata/sf0.001", folder),
        available_now=True, as_of=td.EVENTS_AS_OF).awaitTermination()
    return spark.read.parquet(cfg.output_path)


def _files(spark, folder, parts):
    from veracity.plans import catalog_stream as S
    S.write_event_parts(spark, "/root/testdata/sf0.001", folder, parts)


def test_restart_with_other_salts_equals_the_unbroken_run(spark, tmp_path):
    """4 after 16: the state's salt count goes on."""
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    _files(spark, whole, range(5))
    want = _pipeline(spark, tmp_path, whole, "one", reputation_salts=16)
    _files(spark, cut, range(3))
    _pipeline(spark, tmp_path, cut, "two", reputation_salts=16)
    _files(spark, cut, range(3, 5))
    got = _pipeline(spark, tmp_path, cut, "two", reputation_salts=4)
    assert sorted(map(repr, got.collect())) == sorted(
        map(repr, want.collect()))
    assert got.count() > 900


@pytest.mark.parametrize("change", [
    {"window_duration": "2 hours"}, {"sliding_duration": "20 minutes"},
    {"watermark_delay": "1 hour"}, {"reputation_mode": "exact"}])
def test_restart_with_other_windows_is_refused(spark, tmp_path, change):
    from veracity.streaming.settings import SettingsChanged
    folder = str(tmp_path / "files")
    _files(spark, folder, range(2))
    _pipeline(spark, tmp_path, folder, "q")
    with pytest.raises(SettingsChanged, match=next(iter(change)).split(
            "_")[0].replace("sliding", "slide")):
        _pipeline(spark, tmp_path, folder, "q", **change)
    # the same length in other words is the same setting
    _files(spark, folder, [2])
    _pipeline(spark, tmp_path, folder, "q", window_duration="60 minutes")


def test_checkpoint_without_a_record(spark, tmp_path):
    """Refused with batches, unless adopted; free to change without."""
    import shutil
    from veracity.sources import publish
    from veracity.streaming import settings
    from veracity.streaming.job import StreamingPipelineConfig
    folder = str(tmp_path / "files")
    _files(spark, folder, range(2))
    cfg = StreamingPipelineConfig(checkpoint_dir=str(tmp_path / "new"))
    settings.settle(spark, cfg)
    cfg.window_duration = "3 hours"
    settings.settle(spark, cfg)         # no batch yet: the new one is noted
    assert publish.read_json(spark, f"{cfg.checkpoint_dir}/{settings.RECORD}"
                             )["window_seconds"] == 10_800
    _pipeline(spark, tmp_path, folder, "q")
    shutil.rmtree(tmp_path / "q-ckpt" / "_veracity")
    with pytest.raises(settings.SettingsChanged, match="no record"):
        _pipeline(spark, tmp_path, folder, "q")
    _pipeline(spark, tmp_path, folder, "q", adopt_settings=True)
    _pipeline(spark, tmp_path, folder, "q")


# --- ST1: late records --------------------------------------------------------

def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    """A stop between a batch's output and its log: the batch comes again,
    the files that were shown stay."""
    from veracity.plans import catalog_stream as S
    from veracity.sources import publish
    from veracity.streaming import late
    folder, path = str(tmp_path / "files"), str(tmp_path / "gate")
    _files(spark, folder, range(6))
    stream = S.events_stream(spark, "/root/testdata/sf0.001", folder)
    real, calls = publish.write_json, []

    def stopping(s, to, value):
        calls.append(to)
        if len(calls) == 3:
            raise OSError("stopped")
        real(s, to, value)
    monkeypatch.setattr(publish, "write_json", stopping)
    with pytest.raises(StreamingQueryException):
        late.gate_late_records(stream, path, str(tmp_path / "ckpt"),
                               available_now=True).awaitTermination()
    monkeypatch.setattr(publish, "write_json", real)
    seen = {str(f) for f in (tmp_path / "gate").rglob("*.parquet")}
    late.gate_late_records(stream, path, str(tmp_path / "ckpt"),
                           available_now=True).awaitTermination()
    assert seen <= {str(f) for f in (tmp_path / "gate").rglob("*.parquet")}
    log = late.late_log(spark, path)
    assert [r["batch_id"] for r in log] == list(range(6))
    kept = spark.read.parquet(path + "/accepted")
    gone = late.late_records(spark, path, stream.schema)
    assert kept.count() + gone.count() == 1000
    assert kept.count() == sum(r["accepted"] for r in log)
    assert gone.count() == sum(r["late"] for r in log) > 0
    assert {r.batch_id for r in gone.collect()} == {5}
    marks = [r["watermark"] for r in log]
    assert marks[0] is None and marks[1:] == sorted(marks[1:])


def _fates(spark, sf):
    from veracity.plans import catalog_stream as S
    return sorted(map(tuple, S.q_stream_late_records(spark, sf).collect()),
                  key=lambda r: r[0])


@pytest.mark.parametrize("days, file_rows", [(30, 40), (2, 4)])
def test_every_part_has_the_same_number_of_files(spark, tmp_path, monkeypatch,
                                                 days, file_rows):
    """A part is written by many tasks; one with fewer rows than files has
    as many (2 days: the other parts have no rows)."""
    from veracity.plans import catalog_stream as S
    sf = str(tmp_path / "sf")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.where(F.col("ts") < F.lit(f"2024-01-{days:02} 23:00:00").cast(
        "timestamp_ntz")).coalesce(1).write.parquet(sf + "/events.parquet")
    monkeypatch.setattr(S, "FILE_ROWS", file_rows, raising=False)
    folder, sizes = str(tmp_path / "parts"), []
    for k in range(S.PARTS + 1):
        S.write_event_parts(spark, sf, folder, [k])
        sizes.append(len(list((tmp_path / "parts").glob("*.parquet"))))
    assert sizes[0] > 2
    assert sizes == [sizes[0] * (k + 1) for k in range(S.PARTS + 1)]
    rows = [r["count"] for r in spark.read.parquet(folder).groupBy(
        F.col("_metadata.file_path")).count().collect()]
    assert sum(rows) == spark.read.parquet(sf + "/events.parquet").count()
    assert max(rows) <= file_rows * S.PARTS + 1


def test_fates_do_not_depend_on_the_files(spark, monkeypatch):
    from veracity.plans import catalog_stream as S
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(S, "FILE_ROWS", 1000)
    one = _fates(spark, sf)
    monkeypatch.setattr(S, "FILE_ROWS", 70)
    assert S.part_files(spark, sf) == 3
    assert _fates(spark, sf) == one
    assert {r[3] for r in one} >= {"late", "no time", "scored"}


def test_a_gate_batch_of_several_files_loses_nothing(spark, tmp_path):
    """Its files are days apart: one by one, the last day's would move the
    watermark past the others' records."""
    import datetime as dt
    from veracity.streaming import late
    schema = "source_id string, timestamp timestamp, is_anomaly boolean"
    src, gate = str(tmp_path / "src"), str(tmp_path / "gate")
    for day in (9, 5, 1):
        spark.createDataFrame(
            [("a", dt.datetime(2024, 1, day, 12, m), False)
             for m in range(60)], schema).coalesce(1).write.mode(
                "append").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)

    def run(files):
        late.gate_late_records(
            stream, gate, str(tmp_path / "gate-ckpt"), available_now=True,
            files=files).awaitTermination()
    run(4)                      # more than the batch has tasks
    assert len(list((tmp_path / "gate").rglob("accepted/*/*.parquet"))) == 4
    for wrong in (1, 6):
        with pytest.raises(ValueError, match="may cut"):
            late.accepted_stream(spark, gate, stream.schema, wrong)
    with pytest.raises(ValueError, match="files: 4"):
        run(5)
    s = late.accepted_stream(spark, gate, stream.schema, 4).withWatermark(
        "timestamp", "10 minutes")
    per = s.groupBy(F.window("timestamp", "10 minutes")).count()
    out = str(tmp_path / "out")
    create_output_sink(per, "parquet", out, str(tmp_path / "ckpt"),
                       available_now=True).awaitTermination()
    got = spark.read.parquet(out)
    # the watermark is 12:49 on the 9th: two windows of it stay open
    assert got.agg(F.sum("count")).first()[0] == 160


# --- ST3, S15, ST2: output modes, sinks, triggers -----------------------------

def test_update_layers_survive_a_stop_in_the_merge(spark, tmp_path,
                                                   monkeypatch):
    from veracity.plans import catalog_stream as S
    from veracity.sources import publish
    from veracity.streaming import windows
    from veracity.streaming.job import window_counts, with_watermark
    sf = "/root/testdata/sf0.001"
    folder, path = str(tmp_path / "files"), str(tmp_path / "table")
    keys = ["start", "source_id"]

    def run(parts):
        _files(spark, folder, parts)
        wins = window_counts(with_watermark(S.stream_flags(
            S.events_stream(spark, sf, folder)))).select(
                F.col("win.start").alias("start"), "source_id",
                "total_in_window")
        windows.keyed_sink(wins, path, str(tmp_path / "ckpt"), "update", keys,
                           available_now=True, compact_every=2
                           ).awaitTermination()
        return windows.read_latest(spark, path, wins.schema, keys)

    real = publish.write_json

    def stopping(s, to, value):
        if to.endswith(publish.POINTER):
            raise OSError("stopped")
        real(s, to, value)
    monkeypatch.setattr(publish, "write_json", stopping)
    with pytest.raises(StreamingQueryException):
        run(range(3))
    monkeypatch.setattr(publish, "write_json", real)
    got = run([3, 4])
    e = S.events_stream(spark, sf)      # the batch windows of the same rows
    batch = spark.read.parquet(folder)
    from veracity.operators.unify import map_feed
    from veracity.plans import testdata as td
    rec = map_feed(td.dirty_frame(batch, td.EVENTS, with_key=True),
                   td.mapping(td.EVENTS)).withColumnRenamed(
        "amount", "purchase_amount")
    want = window_counts(S.stream_flags(rec)).select(
        F.col("win.start").alias("start"), "source_id", "total_in_window")
    assert e.isStreaming
    assert sorted(map(repr, got.collect())) == sorted(
        map(repr, want.collect()))
    assert len(publish.names(spark, path + "/layers")) < 2


def _rows(spark, folder):
    spark.range(30).select(F.col("id"), F.concat(
        F.lit('a "b", '), F.col("id")).alias("text")).repartition(3
        ).write.parquet(folder)
    return spark.readStream.schema("id long, text string").parquet(folder)


def test_csv_sink_reads_back(spark, tmp_path):
    out = str(tmp_path / "out")
    s = _rows(spark, str(tmp_path / "in"))
    create_output_sink(s, "csv", out, str(tmp_path / "c"),
                       available_now=True).awaitTermination()
    got = spark.read.option("header", "true").option("escape", "\\").csv(out)
    assert got.columns == ["id", "text"] and got.count() == 30
    assert got.where("id = 7").first().text == 'a "b", 7'


def test_memory_sink_in_every_mode(spark, tmp_path):
    s = _rows(spark, str(tmp_path / "in"))
    create_output_sink(s, "memory", query_name="seen_rows",
                       available_now=True).awaitTermination()
    assert spark.table("seen_rows").count() == 30
    counts = s.groupBy((F.col("id") % 3).alias("k")).count()
    for mode in ("complete", "update"):
        create_output_sink(counts, "memory", output_mode=mode,
                           query_name=f"seen_{mode}", available_now=True
                           ).awaitTermination()
        assert {tuple(r) for r in spark.table(f"seen_{mode}").collect()} == {
            (0, 10), (1, 10), (2, 10)}


CONSOLE = """
import sys
from veracity.session import local_session
from veracity.streaming.sinks import create_output_sink
spark = local_session("console", 2, 2, "1g")
spark.range(30).selectExpr("repeat('long text ', 9) AS text", "id"
                           ).coalesce(1).write.parquet(sys.argv[1])
s = spark.readStream.schema("text string, id long").parquet(sys.argv[1])
create_output_sink(s, "console", available_now=True).awaitTermination()
"""


def test_console_sink_shows_twenty_whole_rows(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", CONSOLE, str(tmp_path / "in")],
                         capture_output=True, text=True, timeout=120,
                         cwd=root).stdout
    assert out.count("|" + "long text " * 9 + "|") == 20
    assert "only showing top 20 rows" in out


def test_processing_time_trigger(spark, tmp_path):
    """Files that come while the query runs are taken at its interval."""
    import time
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    s = _rows(spark, folder)
    q = create_output_sink(s, "parquet", out, str(tmp_path / "c"),
                           trigger_interval="200 milliseconds")
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not q.recentProgress:
            time.sleep(0.1)
        spark.range(100, 110).select("id", F.lit("x").alias("text")
                                     ).write.mode("append").parquet(folder)
        while time.time() < deadline:
            q.processAllAvailable()
            if spark.read.schema("id long, text string").parquet(out
                                                                 ).count() == 40:
                break
            time.sleep(0.1)
    finally:
        q.stop()
    assert spark.read.parquet(out).count() == 40


# --- ST6: state lifetime --------------------------------------------------------

def test_a_silent_source_holds_no_state(spark, tmp_path):
    import datetime as dt
    schema = "source_id string, timestamp timestamp, is_anomaly boolean"
    t0 = dt.datetime(2024, 1, 1, 12)

    def rows(source, start, n):
        return [(source, t0 + dt.timedelta(seconds=start + 7 * k), k % 3 == 0)
                for k in range(n)]
    # b speaks for the first hours, then only a
    parts = [rows("a", 0, 600) + rows("b", 0, 600)] + [
        rows("a", 4200 * (k + 1), 600) for k in range(5)]
    src = str(tmp_path / "src")

    def run(part, k):
        spark.createDataFrame(part, schema).coalesce(1).write.mode(
            "append").parquet(src)
        s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
             .parquet(src).withWatermark("timestamp", "10 minutes"))
        with rocksdb_state(spark):
            q = create_output_sink(exact_stream_reputation(s, 3600),
                                   "parquet", str(tmp_path / "out"),
                                   str(tmp_path / "ckpt"), available_now=True)
            q.awaitTermination()
        ops = [o for p in q.recentProgress for o in p["stateOperators"]
               if "transformWithState" in o["operatorName"]]
        return ops[-1]["numRowsTotal"]
    held = [run(part, k) for k, part in enumerate(parts)]
    # a window of an hour is seven chunks and a timer of a source; b's are
    # gone after the first steps
    assert max(held[:2]) > 9 >= held[-1] > 0
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.where("source_id = 'a'").orderBy(F.desc("timestamp")).first()
    assert last.total_in_window == 3600 // 7 + 1
