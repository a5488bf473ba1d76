"""Unification, schema adaptation, producer cleaning, JSON parsing."""

import datetime as dt

from pyspark.sql import functions as F

from veracity.operators import clean, unify
from veracity.sources import messages

AS_OF = "2024-02-01 00:00:00"


def test_cleanup_rules(spark):
    rows = [("u1", None, "x", "2024-01-01"), ("u2", 0.0, "x", "2024-01-01"),
            ("u3", -5.0, "x", "2024-01-01"), ("u4", 5.0, None, "2024-01-01"),
            ("u5", 5.0, "y", None), ("u6", 5.0, "z", "garbage")]
    df = spark.createDataFrame(rows, "user_id string, amount double, city string, ts string")
    from veracity.sources.feeds import FeedMapping
    m = FeedMapping("t", columns={"user_id": "user_id", "amount": "amount",
                                  "city": "city", "timestamp": "ts"},
                    constants={"source_id": "t"})
    out = unify.load_all_sources([(df, m)], AS_OF).collect()
    assert [(r.user_id, r.city) for r in out] == [("u4", "unknown")]


def test_adapt_schema_cases(spark):
    a = unify.adapt_schema(spark.createDataFrame([(1.0,)], "Amount double"))
    assert "amount" in a.columns and a.first().source_id == "user_upload"
    b = unify.adapt_schema(spark.createDataFrame([(1, 7)], "id int, qty int"))
    assert b.first().amount == 7
    c = unify.adapt_schema(spark.createDataFrame([("x",)], "name string"))
    assert c.first().amount == -999.0


def test_producer_cleaning(spark):
    rows = [(" u1 ", "", "c", "2024-01-01T00:00:00", "s"),
            ("u2", "abc", "c", "2024-01-01T00:00:00", "s"),
            ("  ", "1", "c", "2024-01-01T00:00:00", "s")]
    df = spark.createDataFrame(rows, "user_id string, purchase_amount string, "
                               "city string, timestamp string, source_id string")
    good = clean.clean_records(df).collect()
    assert [(r.user_id, r.purchase_amount) for r in good] == [("u1", None), ("u2", None)]
    bad = clean.reject_records(df).collect()
    assert bad[0].reject_reason == "no_user_id"
    absent = clean.clean_records(df.drop("purchase_amount", "source_id"))
    r = absent.first()
    assert r.purchase_amount == 0.0 and r.source_id == "unknown"


def test_json_malformed_and_wrong_type(spark):
    df = spark.createDataFrame(
        [("{bad",), ('{"user_id":"u","purchase_amount":"x","timestamp":'
                     '"2024-01-01T00:00:00.123456","source_id":"s"}',)], "value string")
    out = messages.prepare_ingestion_fields(messages.parse_messages(df), AS_OF)
    rows = out.collect()
    assert all(v is None for k, v in rows[0].asDict().items()
               if k != "ingestion_timestamp")
    assert rows[1].user_id == "u" and rows[1].purchase_amount is None
    assert rows[1].timestamp == dt.datetime(2024, 1, 1, 0, 0, 0, 123456)


def test_encode_then_parse_roundtrip(spark):
    df = spark.createDataFrame([("u", 1.5, "c", "2024-01-01T00:00:00", "s")],
                               "user_id string, purchase_amount double, city string, "
                               "timestamp string, source_id string")
    back = messages.parse_messages(messages.encode_messages(df))
    assert back.first().asDict() == df.first().asDict()
    assert messages.encode_messages(df).first().key == "u"
    assert F is not None


def test_upload_analysis_job(spark, tmp_path):
    """S3 + U11 + forest + P4 + P5 on a CSV with NULL tokens."""
    from veracity.plans import batch
    path = str(tmp_path / "upload")
    (spark.read.parquet("/root/testdata/sf0.01/customer.parquet")
     .withColumn("c_acctbal", F.when(F.col("c_custkey") % 13 == 0, None)
                 .otherwise(F.col("c_acctbal")))
     .write.option("header", "true").option("nullValue", "NULL").csv(path))
    summary, top = batch.analyze_upload(spark, path, AS_OF)
    s = summary.collect()
    assert len(s) == 1 and s[0].total_records == 1500
    assert 0 < top.count() <= 10
