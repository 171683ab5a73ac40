"""Sessions, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter builds it."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
        # Checkpoints go when nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only where that is unset and all runs on one machine, as in tests, a local one is made."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quotemill-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for tables that outlive a step; remove it when they are done with."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads, if it is there."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, as a mark."""
    fs, at = _files(spark, path)
    fs.create(at, True).close()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    fs, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: later stages survive the loss of an executor without recomputing it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df: the bound is checked by reading no more than max_rows + 1 rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application, as --py-files would."""
    sc = spark.sparkContext
    if getattr(sc, "_quotemill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quotemill-"), "quotemill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("quotemill", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._quotemill_shipped = True
