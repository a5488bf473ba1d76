"""JSON messages on a topic, read and written by Spark.

The parsing and encoding cores work on any DataFrame with a ``value``
column, bounded or streaming, so they are tested on files; the Kafka
source and sink are thin wrappers that need the Kafka connector on the
classpath at submit time (it is not bundled here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.parsing import ISO_PATTERN, parse_timestamp
from ..functions.quality import as_of_column

# --- fixed values: the message schema and consumer settings ---
TRANSACTION_SCHEMA = StructType([
    StructField("user_id", StringType(), False),
    StructField("purchase_amount", DoubleType(), True),
    StructField("city", StringType(), True),
    StructField("timestamp", StringType(), False),
    StructField("source_id", StringType(), False),
])
DEFAULT_TOPIC = "transactions"
# --- end of fixed values ---
# Timestamps in messages keep their microseconds.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def load_kafka_stream(spark: SparkSession, bootstrap_servers: str,
                      topic: str = DEFAULT_TOPIC,
                      starting_offsets: str = "latest",
                      max_offsets_per_trigger: int | None = None,
                      options: dict | None = None) -> DataFrame:
    """Subscribe to a topic (needs the Kafka connector at submit)."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap_servers)
              .option("subscribe", topic)
              .option("startingOffsets", starting_offsets)
              .option("failOnDataLoss", "false"))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger",
                               str(max_offsets_per_trigger))
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader.load()


def parse_messages(df: DataFrame, schema: StructType = TRANSACTION_SCHEMA,
                   keep=()) -> DataFrame:
    """Value bytes/text -> JSON struct -> flat columns.

    Malformed JSON gives an all-null record; a wrongly typed field gives
    a null in that field only.
    """
    body = F.from_json(F.col("value").cast("string"), schema)
    return df.select(*keep, body.alias("data")).select(*keep, "data.*")


def prepare_ingestion_fields(df: DataFrame, as_of=None,
                             patterns=(ISO_PATTERN,),
                             ts_col: str = "timestamp") -> DataFrame:
    """Text timestamp -> timestamp (listed patterns first, then
    Spark's lenient parser; unparsable -> null) and the ingestion time."""
    return df.withColumns({ts_col: parse_timestamp(ts_col, patterns),
                           "ingestion_timestamp": as_of_column(as_of)})


def load_and_parse_kafka(spark: SparkSession, bootstrap_servers: str,
                         topic: str = DEFAULT_TOPIC,
                         schema: StructType = TRANSACTION_SCHEMA,
                         starting_offsets: str = "latest",
                         as_of=None, **kw) -> DataFrame:
    """S10, then S11, then S12."""
    raw = load_kafka_stream(spark, bootstrap_servers, topic,
                            starting_offsets, **kw)
    return prepare_ingestion_fields(parse_messages(raw, schema), as_of)


def encode_messages(df: DataFrame, key_col: str = "user_id",
                    columns=None, keep=()) -> DataFrame:
    """S14 core: one JSON message per record, keyed by ``key_col``."""
    cols = list(columns or [c for c in df.columns if c not in keep])
    return df.select(*keep, F.col(key_col).cast("string").alias("key"),
                     F.to_json(F.struct(*cols), {
                         "timestampFormat": MICROS}).alias("value"))


def publish_messages(df: DataFrame, bootstrap_servers: str,
                     topic: str = DEFAULT_TOPIC) -> None:
    """Write keyed JSON messages to a topic (acks=all, 3 retries).

    A distributed batch write from the executors, not a per-row client
    loop on the driver.
    """
    (encode_messages(df).write.format("kafka")
     .option("kafka.bootstrap.servers", bootstrap_servers)
     .option("kafka.acks", "all").option("kafka.retries", "3")
     .option("topic", topic).save())
