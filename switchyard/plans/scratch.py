"""Tables that are written once and read several times within a plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: tempfile.TemporaryDirectory | None = None


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a local session uses a folder that goes with the
    process; any other raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        global _local
        if _local is None:
            _local = tempfile.TemporaryDirectory(prefix="switchyard-plans-")
            atexit.register(_local.cleanup)
        root = f"file://{_local.name}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder of that kind, which goes with the session."""
    path = new_path(spark, name)
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    home.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(home)
    gone_at_end(spark, path)
    return path


def gone_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path``, which exists, when the session's JVM ends: what a query returns may read it until then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet, read back: computed once, and a lost executor costs a read."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    gone_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
