"""WARC archives with revisit resolution.

Records are headers plus payload.  The headers (a digest and an id, no
payload) are shuffled by payload digest; of records with equal payloads
one stays a response and the others become revisits that refer to it,
which needs one maximum per digest and a join back that AQE can split
where a payload is very common.  Archives are written with fresh headers
by Spark's text sink: its line separator is the blank line pair that ends
a WARC record, so a part file is a WARC stream (gzip-compressed).

Reading takes whole part files (their size is bounded when writing) and
follows Content-Length, so a payload may hold anything, header lines of
another record included.  Revisits get their payload's length and digest
back by joining the response they refer to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from ..session import scratch_path

# --- fixed values of the WARC 1.1 format and RFC 4648 ---
VERSION = "WARC/1.1"
REVISIT_PROFILE = ("http://netpreserve.org/warc/1.1/revisit/"
                   "identical-payload-digest")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
# --- end of fixed values ---
RECORD_URI = "urn:x-record:"


@dataclass(frozen=True)
class WarcParams:
    """``min_bytes``: smaller payloads are all responses.  ``file_bytes``:
    payload bytes a part file holds on average."""

    min_bytes: int = 0
    file_bytes: int = 8 << 20
    date: str = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits make four letters."""
    digest = F.upper(F.sha1(payload))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * g, 5), 16, 32), 4,
                     "0") for g in range(8)]
    return F.translate(F.concat(*groups), BASE32_HEX, BASE32)


def _header_value(col: Column) -> Column:
    """Text without control characters, which would end a header line."""
    return F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")),
                            r"[\x00-\x1F\x7F]", " ")


def resolve(records: DataFrame, params: WarcParams = WarcParams()
            ) -> DataFrame:
    """Add record_type and refers_to to records (record_id, payload_bytes,
    payload_digest).

    Of records with one digest and at least ``min_bytes``, that with the
    largest record_id is the response (rows that repeat it all are); the
    others revisit it.  A record without an id can't be referred to: it is
    a revisit of a named equal record if there is one, else a response.
    """
    groups = (records.where(F.col("payload_bytes") >= params.min_bytes)
              .groupBy("payload_digest", "payload_bytes")
              .agg(F.max("record_id").alias("__first"),
                   F.count("*").alias("__n")))
    common = groups.where("__n > 1").drop("__n")
    out = records.join(common, ["payload_digest", "payload_bytes"], "left")
    again = F.col("__first").isNotNull() & ~F.col("record_id").eqNullSafe(
        F.col("__first"))
    return out.withColumn(
        "record_type", F.when(again, "revisit").otherwise("response")
    ).withColumn("refers_to", F.when(again, F.col("__first"))).drop("__first")


def write_archives(pages: DataFrame, path: str,
                   params: WarcParams = WarcParams(), id_col: str = "page_id",
                   url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record per row of ``pages`` under ``path``, deduplicated.

    Payloads are UTF-8 text; null counts as empty.  A null url has an
    empty target URI; a null id an empty record id.  An empty table
    writes no records.
    """
    rows = C.own_columns(pages, {id_col: "record_id", url_col: "url",
                                 payload_col: "payload"})
    payload = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    rows = rows.withColumn("payload", payload).withColumn(
        "record_id", F.col("record_id").cast("long"))
    body = F.col("payload").cast("binary")
    headers = C.save(rows.select(
        "record_id", F.octet_length("payload").cast("long")
        .alias("payload_bytes"), base32_sha1(body).alias("payload_digest")),
        "warc-headers")
    kinds = resolve(headers, params).where("record_type = 'revisit'").select(
        F.col("record_id").alias("__id"),
        F.col("payload_digest").alias("__digest"), "refers_to").distinct()
    total = headers.agg(F.count("*").alias("n"),
                        F.sum("payload_bytes").alias("b")).first()
    each = max(1, (total["n"] or 0) * params.file_bytes
               // max(total["b"] or 0, 1))
    rows = rows.withColumn("digest", base32_sha1(body))
    rows = rows.join(kinds, F.col("record_id").eqNullSafe(F.col("__id"))
                     & (F.col("digest") == F.col("__digest")), "left")
    revisit = F.col("refers_to").isNotNull()
    end = "\r\n"
    name = F.concat(F.lit(f"<{RECORD_URI}"), F.coalesce(
        F.col("record_id").cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"{VERSION}{end}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{end}WARC-Record-ID: "), name,
        F.lit(f"{end}WARC-Date: {params.date}{end}WARC-Target-URI: "),
        _header_value(F.col("url")),
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit(f"{end}WARC-Profile: {REVISIT_PROFILE}"
                  f"{end}WARC-Refers-To: <{RECORD_URI}"),
            F.col("refers_to").cast("string"), F.lit(">"))).otherwise(
            F.lit("")),
        F.lit(f"{end}Content-Type: text/html{end}Content-Length: "),
        F.when(revisit, F.lit("0")).otherwise(
            F.octet_length("payload").cast("string")),
        F.lit(end + end),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    # the join has dealt the payloads out: they are written where they are
    (rows.select(head.alias("value")).write.option("lineSep", end + end)
     .option("maxRecordsPerFile", each).option("compression", "gzip")
     .text(path))


RECORD_SCHEMA = ("record_type string, record_id long, url string, "
                 "payload_digest string, refers_to long, payload binary")


def _number(uri: str) -> int | None:
    digits = uri.strip("<>").removeprefix(RECORD_URI)
    return int(digits) if digits else None


def _records(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "")
                    for x in lines[1:])
        size = int(head["Content-Length"])
        body = data[stop + 4:stop + 4 + size]
        at = stop + 4 + size + 4
        refers = head.get("WARC-Refers-To")
        yield (head["WARC-Type"], _number(head["WARC-Record-ID"]),
               head["WARC-Target-URI"],
               head["WARC-Payload-Digest"].removeprefix("sha1:"),
               _number(refers) if refers else None, body)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for r in _records(gzip.decompress(content.as_py())):
                if r[0] == "response":
                    sha = base64.b32encode(hashlib.sha1(r[5]).digest())
                    if sha.decode() != r[3]:
                        raise ValueError(f"digest of record {r[1]} is wrong")
                rows.append(r)
                held += len(r[5])
                if held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
             pa.binary()]
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds,
                                           strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``; each response's payload
    is checked against its digest."""
    files = (spark.read.format("binaryFile").option(
        "pathGlobFilter", "*.txt.gz").load(path).select("content"))
    return files.mapInArrow(_parse, RECORD_SCHEMA)


def resolved_records(spark: SparkSession, path: str) -> DataFrame:
    """Records as read, revisits with their response's payload length."""
    rows = read_archives(spark, path).select(
        "record_type", "record_id", "payload_digest", "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"))
    rows = C.save(rows, "warc-read")
    originals = rows.where("record_type = 'response'").select(
        F.col("record_id").alias("__id"),
        F.col("payload_digest").alias("__digest"),
        F.col("payload_bytes").alias("__bytes")).distinct()
    out = rows.join(originals, (F.col("refers_to") == F.col("__id")) & (
        F.col("payload_digest") == F.col("__digest")), "left")
    return out.select(
        "record_type", "record_id", "payload_digest", "refers_to",
        F.when(F.col("record_type") == "revisit", F.col("__bytes"))
        .otherwise(F.col("payload_bytes")).alias("payload_bytes"))


def archive_pages(pages: DataFrame, params: WarcParams = WarcParams()
                  ) -> DataFrame:
    """Write ``pages`` to archives in the scratch folder, read them back
    and resolve: page_id, payload_bytes, payload_digest, record_type,
    refers_to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, params)
    return resolved_records(spark, path).select(
        F.col("record_id").alias("page_id"), "payload_bytes",
        "payload_digest", "record_type", "refers_to")
