"""The folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where the setting is absent a temporary folder is made, in local mode only:
    on a cluster such a folder would not be visible to the executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="kappaloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_made: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, which clear() deletes."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables that this process has made. Frames that still read them are void then: write their results first."""
    remove(spark, *_made)
    _made.clear()


def staged(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    return staged_at(df, label, compression)[0]


#: Rows that a plan may carry with it.
FEW = 4096


def settled(df: DataFrame, label: str) -> tuple[DataFrame, bool]:
    """df computed once, and whether it is small: up to FEW rows are carried by later plans, and then by broadcasts; more are written as by staged()."""
    table = df.limit(FEW + 1).toArrow()
    if table.num_rows > FEW:
        return staged(df, label), False
    return df.sparkSession.createDataFrame(table, df.schema).coalesce(1), True


def staged_at(df: DataFrame, label: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Have the driver collect its garbage: the shuffle files of plans that are done stay on the executors' disks until it does. Python's first, as its frames hold plans."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside give up their shuffle files as they end; no garbage need be collected for that."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
