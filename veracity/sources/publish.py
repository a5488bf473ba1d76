"""Folders that change as a whole: staged tables and versioned folders.

Two ways, for two kinds of reader:

* A **versioned folder** (models) holds generations and one small pointer
  file.  A writer makes a generation of its own and then replaces the
  pointer, which is one atomic rename: a reader gets the old or the new
  generation at any stop, never a mix.
* A **staged table** is a plain Parquet folder.  It is written beside the
  old one, its rows are counted, and then the folders are swapped by two
  renames.  A stop between the two is mended by whoever comes next, reader
  or writer (``recover_table``).

Both ask the file system that the path names, through Spark's Hadoop
configuration.  Renames are atomic on HDFS and local disks; an object
store that copies instead should be given a table format (S9).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"
COMPLETE = "_COMPLETE"          # a name Spark's readers skip


# --- small files -------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it is absent."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a folder or file to a name that is free."""
    fs, p = _fs(spark, old)
    to = _fs(spark, new)[1]
    if fs.exists(to) or not fs.rename(p, to):
        raise OSError(f"can't move {old} to {new}")


def copy(spark: SparkSession, old: str, new: str) -> None:
    """Copy a small file."""
    fs, p = _fs(spark, old)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(
        fs, p, fs, _fs(spark, new)[1], False,
        spark.sparkContext._jsc.hadoopConfiguration())


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small file's content; None if there is no such file."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Replace a small file in one step: readers see the old content or
    the new, whole."""
    sc = spark.sparkContext
    fs, p = _fs(spark, path)
    part = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")[1]
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        stream.close()
    hadoop = sc._jvm.org.apache.hadoop.fs
    how = sc._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(
        fs.getUri(), sc._jsc.hadoopConfiguration()).rename(
            fs.makeQualified(part), fs.makeQualified(p), how)


# --- versioned folders -------------------------------------------------------

def publish_generation(spark: SparkSession, path: str,
                       write: Callable[[str], dict | None]) -> str:
    """``write(folder)`` fills a new generation and returns facts about it
    that the pointer keeps; then the pointer turns to it.  The generation
    before stays for readers that have just looked, older ones go.
    Generations that a stopped writer left are not looked at."""
    name = f"gen-{uuid.uuid4().hex}"
    facts = write(f"{path}/{name}")
    old = read_json(spark, f"{path}/{POINTER}") or {}
    write_json(spark, f"{path}/{POINTER}",
               {"generation": name, "previous": old.get("generation"),
                "facts": facts or {}})
    if old.get("previous"):
        delete(spark, f"{path}/{old['previous']}")
    return f"{path}/{name}"


def current_generation(spark: SparkSession, path: str
                       ) -> tuple[str, dict] | None:
    """(folder, facts) of the generation in force."""
    found = read_json(spark, f"{path}/{POINTER}")
    return found and (f"{path}/{found['generation']}", found["facts"])


def remove_orphans(spark: SparkSession, path: str) -> list[str]:
    """Delete generations that no pointer names (left by stopped writers);
    call it while nobody writes."""
    found = read_json(spark, f"{path}/{POINTER}") or {}
    keep = {found.get("generation"), found.get("previous")}
    gone = [n for n in names(spark, path)
            if n.startswith("gen-") and n not in keep]
    for n in gone:
        delete(spark, f"{path}/{n}")
    return gone


# --- staged tables -----------------------------------------------------------

def _beside(path: str, what: str) -> str:
    return f"{path.rstrip('/')}.{what}"


def recover_table(spark: SparkSession, path: str) -> None:
    """Finish or undo a swap that was stopped half way: the new table if it
    was complete, else the old one.  A table that stands is not touched,
    nor is one that is being written beside it."""
    if exists(spark, path):
        return
    old, new = _beside(path, "old"), _beside(path, "new")
    if exists(spark, f"{new}/{COMPLETE}"):
        rename(spark, new, path)
    elif exists(spark, old):
        rename(spark, old, path)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table, after mending a swap that was stopped."""
    recover_table(spark, path)
    return spark.read.parquet(path)


def publish_table(spark: SparkSession, path: str,
                  frames: Sequence[DataFrame], load_id: str | None = None,
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """Write the frames as one table and put it in the place of the old
    one.  Until the swap the old table stays as it is; if a frame fails, or
    the written rows are not as many as the frames gave, nothing changes.

    ``load_id``: a load that is already the table's is not written again.
    The frames have the first one's columns and types (cast by name).
    Readers may come at any time; a table has one writer at a time.
    """
    recover_table(spark, path)
    done = read_json(spark, f"{path}/{COMPLETE}")
    if load_id is not None and done and done.get("load_id") == load_id:
        return spark.read.parquet(path)
    new, old = _beside(path, "new"), _beside(path, "old")
    delete(spark, new)          # what a stopped load has left
    delete(spark, old)
    given = 0
    for i, frame in enumerate(frames):
        rows = frame.select(*[F.col(f"`{c}`").cast(t).alias(c)
                              for c, t in frames[0].dtypes])
        given += write_counted(rows, new, "overwrite" if i == 0 else "append",
                               partition_by)
    written = spark.read.schema(frames[0].schema).parquet(new).count()
    if written != given:
        raise OSError(f"{path}: {given} rows given, {written} written")
    facts = {"load_id": load_id, "rows": written, "key": uuid.uuid4().hex}
    write_json(spark, f"{new}/{COMPLETE}", facts)
    if exists(spark, path):
        rename(spark, path, old)
    try:
        rename(spark, new, path)
    except OSError:     # a reader has mended the swap already
        if read_json(spark, f"{path}/{COMPLETE}") != facts:
            raise
    delete(spark, old)
    return spark.read.parquet(path)


def write_counted(df: DataFrame, path: str, mode: str,
                  partition_by: Sequence[str] = ()) -> int:
    """Write Parquet and return the rows that went through the plan,
    observed on the way."""
    from pyspark.sql import Observation
    seen = Observation()
    w = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return seen.get["rows"]


def append_once(df: DataFrame, path: str, load_id: str) -> DataFrame:
    """Append a load to a table once.  Its files carry the load's id;
    the load counts when its marker stands.  A load without one (a stopped
    try) is taken out before it is written again; a load with one is not
    written again."""
    spark = df.sparkSession
    marker = f"{path}/_loads/{load_id}"
    if not exists(spark, marker):
        prefix = f"load-{load_id}-"
        for n in names(spark, path):
            if n.startswith(prefix):
                delete(spark, f"{path}/{n}")
        stage = f"{path}/_stage-{load_id}"
        rows = write_counted(df, stage, "overwrite")
        make_folder(spark, f"{path}/_loads")
        for n in names(spark, stage):
            if n.startswith("part-"):
                rename(spark, f"{stage}/{n}", f"{path}/{prefix}{n}")
        write_json(spark, marker, {"rows": rows})
        delete(spark, stage)
    return spark.read.parquet(path)
