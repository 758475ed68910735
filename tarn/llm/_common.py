"""Helpers shared by the training-data operators: shared storage and text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.storage import drop, drop_path, materialise, scratch, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids of a checked number that may be sent to all executors.
MOST_IDS = 500_000


def only(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose ``key`` is (``left_anti``: isn't) among ``ids``, distinct and written: sent to the rows where their number is checked to be small, so texts don't move."""
    few = ids.limit(MOST_IDS + 1).count() <= MOST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


_cache: dict[object, object] = {}


def worker_cache(key: object, make):
    """What ``make`` gives, kept in a Python worker between tasks until another operator, or another key, asks for its own: workers outlive jobs, and hold one cache at a time."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = make()
    return _cache[key]


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a thousand rows at a time, where the session hasn't another number than Spark's own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def tidy() -> None:
    """Give back what a task of a Python worker has freed; allocators would keep it for as long as the worker lives."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts as empty ones; other columns can't clash."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def pick(condition: Column, value: Column) -> Column:
    return F.when(condition, value)
