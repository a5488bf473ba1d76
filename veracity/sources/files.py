"""File sources and sinks."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.quality import as_of_column
from . import publish
from .feeds import FeedMapping, mapping_for_file


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             null_value: str | None = None, header: bool = True,
             infer: bool = False) -> DataFrame:
    """CSV with a header.  Without a schema every column is text
    (only the header is read beforehand; ids like 007 stay as they are)
    and the mapping casts it; ``infer`` types the columns, which reads the
    whole file once more."""
    r = spark.read.option("header", str(header).lower())
    if null_value is not None:
        r = r.option("nullValue", null_value)
    r = r.schema(schema) if schema is not None else r.option(
        "inferSchema", str(infer).lower())
    return r.csv(path)


def load_csv_data(spark: SparkSession, path: str,
                  schema: StructType | None = None, as_of=None) -> DataFrame:
    """CSV, types inferred, plus an ``ingestion_timestamp``."""
    return read_csv(spark, path, schema, infer=schema is None).withColumn(
        "ingestion_timestamp", as_of_column(as_of))


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, asked of the file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def header_catalogue(spark: SparkSession, folder: str,
                     pattern: str = "*.csv") -> DataFrame:
    """(path, header) of every file below a folder whose name, or whose
    folder's name, fits the pattern: the first line that isn't blank, read
    by the executors in one pass over the lines.  A file without such a
    line has no rows and no entry.

    A task keeps one line per file as the lines pass; an aggregate over
    texts would sort all lines of the files' first blocks."""
    lines = (spark.read.text(f"{folder}/{pattern}")
             .select("value", F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("n")))
    first = lines.where((F.col("block") == 0)
                        & (F.length(F.trim("value")) > 0))
    first = first.select("path", "value", "n").mapInArrow(
        _first_lines(), "path string, value string, n long")
    return first.groupBy("path").agg(F.min_by("value", "n").alias("header"))


def _first_lines():
    """The first line of each stretch of lines of one file; made here, so
    that it goes to the executors whole."""
    def first_lines(batches: Iterator[pa.RecordBatch]
                    ) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            paths = b.column("path")
            if not len(paths):
                continue
            new = pc.not_equal(paths.slice(1), paths.slice(0, len(paths) - 1))
            new = pa.concat_arrays(
                [pa.array([paths[0].as_py() != last]), new])
            last = paths[-1].as_py()
            yield b.filter(new)
    return first_lines


def header_names(header: str) -> list[str]:
    """Column names of a CSV header as a reader of the file would have
    them: quotes removed, an empty name is ``_c`` and its place, a repeated
    one gets its place behind it."""
    names = [n.strip() for n in next(csv.reader([header.lstrip("\ufeff")],
                                                escapechar="\\"))]
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1
            else n for i, n in enumerate(names)]


def _named(path: str, folder: str) -> str:
    """The part of a path that a mapping goes by: the file in the folder,
    or the folder in it that holds the file's parts."""
    return path.split(f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/", 1)[
        -1].split("/", 1)[0]


def read_feed_directory(spark: SparkSession, folder: str,
                        mappings: Sequence[FeedMapping],
                        file_col: str | None = None
                        ) -> list[tuple[DataFrame, FeedMapping | None]]:
    """The CSV files of a folder with the mapping that their name
    selects: one scan for all files that have the same mapping and header,
    however many.  Columns are text.  ``file_col`` adds each row's file."""
    groups: dict[tuple, list[str]] = {}
    # names only: a path and a header per file, not their rows
    for r in header_catalogue(spark, folder).toLocalIterator():
        m = mapping_for_file(_named(r["path"], folder), mappings)
        groups.setdefault((m.name if m else "", r["header"]), []).append(
            r["path"])
    by_name = {m.name: m for m in mappings}
    out = []
    for (name, header), paths in sorted(groups.items()):
        schema = StructType([StructField(n, StringType())
                             for n in header_names(header)])
        df = spark.read.option("header", "true").schema(schema).csv(
            sorted(paths))
        if file_col:
            df = df.select("*", F.col("_metadata.file_path").alias(file_col))
        out.append((df, by_name.get(name)))
    return out


def read_csv_rows(spark: SparkSession, path: str,
                  row_col: str = "row_number", **kw) -> DataFrame:
    """U13's input: a CSV (a file, or a folder of parts in path order) with
    each row's number from 0, the header not counted."""
    from ..operators.numbering import number_file_rows
    return number_file_rows(read_csv(spark, path, **kw), row_col)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> None:
    """Distributed write by the executors (never through
    the driver).  ``partition_by`` (e.g. source_id) lets later reads prune
    whole folders."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_file_count(df: DataFrame, path: str, count: int,
                     mode: str = "overwrite") -> None:
    """Write Parquet as exactly ``count`` files, for a file stream that
    takes so many at a time: each task writes one, and files without rows
    make up for tasks that are missing or have none."""
    spark = df.sparkSession

    def held() -> list[str]:
        return [n for n in publish.names(spark, path) if n.startswith("part-")]
    before = 0 if mode == "overwrite" else len(held())
    df.coalesce(count).write.mode(mode).option(
        "maxRecordsPerFile", 0).parquet(path)
    missing = before + count - len(held())
    if missing:
        key = uuid.uuid4().hex
        spare = f"{path}/_spare-{key}"
        spark.createDataFrame([], df.schema).coalesce(1).write.parquet(spare)
        one = next(n for n in publish.names(spark, spare)
                   if n.startswith("part-"))
        for i in range(missing):
            publish.copy(spark, f"{spare}/{one}",
                         f"{path}/part-spare-{key}-{i}.parquet")
        publish.delete(spark, spare)


def append_feeds(frames: Sequence[DataFrame], path: str,
                 load_id: str | None = None) -> DataFrame:
    """The frames as one table in the place of the old one, re-read.

    Columns are aligned by name and cast to the first frame's types, so one
    folder never holds two types for a column.  The old table stays until
    all frames are written and counted (``publish.publish_table``)."""
    return publish.publish_table(frames[0].sparkSession, path, frames,
                                 load_id)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def has_data_source(spark: SparkSession, class_name: str) -> bool:
    """Whether a connector's class can be loaded by the driver."""
    jvm = spark.sparkContext._jvm
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    name = class_name.replace(".", "/") + ".class"
    return loader.getResource(name) is not None


def write_delta(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Delta when its connector is on the classpath, else Parquet.

    Only the connector's absence leads to Parquet; any error of the write
    itself is raised."""
    if has_data_source(df.sparkSession, "io.delta.sql.DeltaSparkSession"
                       "Extension"):
        df.write.format("delta").mode(mode).save(path)
    else:
        write_parquet(df, path, mode)
