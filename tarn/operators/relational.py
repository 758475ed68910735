"""Relational operators of the scan and of history: windows, chunks, dedupe, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_windows(hits: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 64) -> DataFrame:
    """Intervals of each key merged where at most ``gap`` apart: a running maximum, islands, one row for each."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("hits")).drop("_island")


def prefer(found: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in the order."""
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def merge_sorted_runs(runs: list[DataFrame]) -> DataFrame:
    """The distinct rows of several runs."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.distinct()


def canonical_context(candidates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's smallest context, by the order of the columns; no row is sorted."""
    return candidates.groupBy(key).agg(F.min(F.struct(*order)).alias("_m")).select(key, "_m.*")


def rules_by_anchor(objects: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """Objects with each rule one of whose anchors they contain. ``rules`` is as large as the rule set; its size is checked."""
    most = 10_000
    own = rules.limit(most + 1).collect()
    if len(own) > most:
        raise ValueError("more rules than a plan can hold")
    each = [F.when(F.exists(F.lit(list(r.anchors)), lambda a: F.contains(F.col(text), a)), F.lit(r.rule)) for r in own]
    return objects.withColumn("rule", F.explode(F.array_compact(F.array(*each))))


def log2_histogram(rows: DataFrame, value: str) -> DataFrame:
    bucket = F.when(F.col(value) < 1, F.lit(0)).otherwise(F.floor(F.log2(F.floor(value))) + 1)
    return rows.groupBy(bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
