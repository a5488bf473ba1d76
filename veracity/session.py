"""Session helpers.

Library operators never create or reconfigure a session: they take the
DataFrames they are given.  These helpers exist for tests, the bench and
small command-line runs, and for the one setting the library reads from
the session: the shared checkpoint folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "veracity", cpus: int | str = "*",
                  shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A local session configured like the tests and bench expect.

    UTC session time, AQE on (coalescing and skew-join splitting), Arrow
    on for pandas UDFs.  On a cluster the caller's session is used as is.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared folder there; it is read from the session
    and used as is.  When the setting is absent, a local master gets a
    fresh folder under the system temp dir (tests); any other master
    raises, since a driver-local folder is invisible to its executors.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(
                f"spark.checkpoint.dir is not set and the master is {master}: "
                "name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="veracity-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh name under the shared checkpoint folder for a written table.

    Only the name is made; Spark's writer creates the folder on whatever
    file system the checkpoint folder lives.
    """
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a scratch table through the file system Spark resolves."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(p, True)
