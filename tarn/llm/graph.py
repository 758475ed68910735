"""Connected components of an edge table by alternating star contraction.

Rounds of joins and aggregations; no link or component reaches the driver but as
counts. Every round is written to the shared folder, which cuts the lineage,
and aggregates are written before they are joined, so that Spark can split the rows
of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._common import drop, materialise


ROWS_PER_FILE = 250_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Link each neighbour larger than u to the smallest in u's neighbourhood."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).coalesce(parts), "least")
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a")).where("a <> b").distinct()
    out = materialise(large.coalesce(parts), "large")
    drop(least)
    return out


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Link u and each neighbour smaller than u to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "least")
    moved = down.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    star = moved.unionAll(least.select(F.col("u").alias("b"), F.col("m").alias("a"))).where("a <> b").distinct()
    out = materialise(star.select("a", "b").coalesce(parts), "star")
    drop(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that some edge (a, b) names; component is the smallest id reachable."""
    now = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "edges")
    before = None
    parts = max(8, now.count() // ROWS_PER_FILE)  # many small files would cost more than the work
    while True:
        large = _large_star(now, parts)
        drop(now)
        now = _small_star(large, parts)
        drop(large)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, parts = state, max(8, state[0] // ROWS_PER_FILE)
    return now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).unionAll(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
