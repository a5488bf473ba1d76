"""The command-line jobs, and storage that must not hide errors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veracity.jobs import score, stream, train
from veracity.operators.forest import IsolationForestModel
from veracity.sources import files


def feed_csv(spark, path, n=400):
    (spark.range(n).select(
        F.format_string("%03d", "id").alias("user_id"),
        (F.col("id") % 90 + 0.5).alias("purchase_amount"),
        F.lit("X").alias("city"),
        F.lit("2024-01-05T10:00:00").alias("timestamp"))
     .coalesce(1).write.option("header", "true").csv(path))


def test_train_then_score_then_stream(spark, tmp_path):
    raw = str(tmp_path / "feeds/transactions.csv")
    feed_csv(spark, raw)
    model = str(tmp_path / "model")
    assert train.main(["--input", raw, "--output", model,
                       "--sample-fraction", "0.5",
                       "--contamination", "0.1"], spark) == 0
    m = IsolationForestModel.load(spark, model)
    assert m.params.contamination == 0.1 and m.params.sample_fraction == 0.5
    assert m.sample_size >= 256

    out = str(tmp_path / "scores")
    given = ["--feeds", str(tmp_path / "feeds"), "--output", out,
             "--as-of", "2024-02-01 00:00:00"]
    assert score.main(given, spark) == 1        # three feeds are absent
    assert score.main([*given, "--allow-missing"], spark) == 0
    rows = spark.read.parquet(out)
    assert rows.count() == 400 and len(rows.columns) == 13
    assert "007" in {r.user_id for r in rows.select("user_id").collect()}

    msgs = str(tmp_path / "messages")
    (files.read_csv(spark, raw).withColumn("source_id", F.lit("s"))
     .select(F.to_json(F.struct("*")).alias("value")).write.text(msgs))
    scored = str(tmp_path / "stream")
    assert stream.main(["--model", model, "--output", scored,
                        "--checkpoint", str(tmp_path / "ckpt"),
                        "--mode", "micro_batch", "--messages", msgs,
                        "--available-now", "--all-columns"], spark) == 0
    assert spark.read.parquet(scored).count() == 400


def test_missing_input_and_columns(spark, tmp_path):
    model = str(tmp_path / "model")
    assert train.main(["--input", str(tmp_path / "no.csv"), "--output",
                       model], spark) == 1
    spark.range(3).write.option("header", "true").csv(str(tmp_path / "x.csv"))
    assert train.main(["--input", str(tmp_path / "x.csv"), "--output",
                       model], spark) == 1
    assert score.main(["--feeds", str(tmp_path), "--output", model,
                       "--allow-missing"], spark) == 1


def test_write_errors_surface(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    files.write_delta(spark.range(3), path)          # no connector: Parquet
    assert spark.read.parquet(path).count() == 3
    monkeypatch.setattr(files, "has_data_source", lambda *_: True)
    with pytest.raises(Exception):
        files.write_delta(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_scratch_needs_a_shared_folder(spark):
    from veracity import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    name = session.scratch_path(spark, "x")
    assert not files.path_exists(spark, name)
    spark.range(1).write.parquet(name)
    assert session.delete_path(spark, name)
    assert not files.path_exists(spark, name)


@pytest.mark.parametrize("n", [0, 1, 20])
def test_small_uploads(spark, tmp_path, n):
    from veracity.plans import batch
    path = str(tmp_path / "u")
    (spark.range(n).select("id", (F.col("id") * 2.5).alias("Amount"))
     .coalesce(1).write.option("header", "true").csv(path))
    if n == 0:      # a header alone
        (tmp_path / "u" / "head.csv").write_text("id,Amount\n")
    summary, top = batch.analyze_upload(spark, path,
                                        dt.datetime(2024, 2, 1))
    total = [r.total_records for r in summary.collect()]
    assert total in ([n], []) and top.count() <= n
