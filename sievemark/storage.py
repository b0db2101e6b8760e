"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; only a local master may go without it, in a folder of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sievemark-"))
    return _LOCAL[0]


def path_of(spark: SparkSession, path: str) -> tuple[object, object]:
    """(file system, path) of Hadoop, which also reads folders that only Spark can open."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = path_of(spark, path)
    fs.delete(p, True)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session may have gone by then
        delete(spark, path)


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; it goes when the interpreter ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_forget, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, whatever reads it how often."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
