"""Shared storage for intermediate results."""

from __future__ import annotations

import atexit
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the session's checkpoint folder; without either it is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return known.rstrip("/")


#: Paths that this driver has made and not deleted, and the paths of tables it has written there.
_left: set[str] = set()
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before; it is deleted when the driver ends, or earlier by ``drop_path``."""
    path = f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_clear, weakref.ref(spark))
    _left.add(path)
    return path


def _clear(session) -> None:
    spark = session()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in sorted(_left):
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _left.discard(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts the lineage.

    Unlike a cached table it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, _written.pop(t))
