"""Arriving objects: a stream of files or rows, scanned batch by batch, each content once.

The stream's own checkpoint and the state's committed runs make each batch count once:
a batch that is run again finds its objects seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.operators.scan import scan
from tarn.sources.state import State


def scan_stream(objects: DataFrame, state: State, checkpoint: str, *, id_col: str = "path", content_col: str = "content", repo_id: str = "stream", policy: str = "", rules=None) -> StreamingQuery:
    """Scan a streaming frame of (id, content) into ``state``; contents seen before are skipped."""

    def batch(rows: DataFrame, epoch: int) -> None:
        keyed = rows.select(F.col(id_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content")).withColumn("oid", F.sha2("content", 256))
        new = keyed.join(state.read("seen_blob").where((F.col("repo_id") == repo_id) & (F.col("policy_hash") == policy)).select("oid"), "oid", "left_anti")
        once = new.groupBy("oid").agg(F.min("path").alias("path"), F.first("content").alias("content"))
        found = scan(once, rules, id_col="oid")
        key = [F.lit(repo_id).alias("repo_id"), F.lit(policy).alias("policy_hash")]
        state.persist(
            {
                "blob_ctx": once.select(*key, "oid", F.lit(str(epoch)).alias("commit_id"), "path"),
                "finding": found.select(*key, F.col("object_id").alias("oid"), F.col("root_start").alias("start"), F.col("root_end").alias("end"), "rule_id", "norm_hash").distinct(),
                "seen_blob": once.select(*key, "oid"),
            },
            complete=True,
        )

    return objects.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
