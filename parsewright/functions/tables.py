"""Tables written to the folder that all executors share, which cut lineage and have a size that joins can go by."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; where neither is set (tests), a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="parsewright-"))
    return _own[0]


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # at exit the JVM may be gone already
        return


def place(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed at the end."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, with its schema given so that an empty table reads as well; removed at the end."""
    spark = df.sparkSession
    path = place(spark, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
