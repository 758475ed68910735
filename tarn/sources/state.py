"""Incremental state: contexts, findings, seen blobs and ref watermarks as tables.

A run writes its data first and its watermarks last; readers trust only runs that have
a marker, so a run that fails leaves nothing behind that counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.rules import Rule

TABLES = {
    "blob_ctx": "repo_id string, policy_hash string, oid string, commit_id string, path string, parent_idx int, change string, mode string, path_class int",
    "finding": "repo_id string, policy_hash string, oid string, start long, end long, rule_id int, norm_hash string",
    "seen_blob": "repo_id string, policy_hash string, oid string",
    "ref_watermark": "repo_id string, policy_hash string, start_set_id string, ref string, tip string",
}


def policy_hash(rules: list[Rule], tuning: object, path_version: int = 1, merge_mode: str = "all_parents") -> str:
    """A hash of all that decides findings, whatever the order of the rules; local context counts too."""
    parts = sorted(hashlib.sha256(repr(r).encode()).hexdigest() for r in rules)
    return hashlib.sha256(json.dumps([parts, repr(tuning), path_version, merge_mode]).encode()).hexdigest()


def start_set_id(which: str, explicit: tuple[str, ...] = ()) -> str:
    return hashlib.sha256(json.dumps([which, sorted(set(explicit))]).encode()).hexdigest()


class State:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def read(self, name: str) -> DataFrame:
        """The rows of committed runs."""
        schema = TABLES[name]
        if not self._exists("committed") or not self._exists(name):
            return self.spark.createDataFrame([], schema)
        runs = self.spark.read.schema("run string").json(f"{self.path}/committed")
        rows = self.spark.read.schema(f"{schema}, run string").parquet(f"{self.path}/{name}")
        return rows.join(runs.distinct(), "run", "left_semi").drop("run")

    def watermarks(self) -> DataFrame:
        """The last committed tip of each ref."""
        if not self._exists("committed") or not self._exists("ref_watermark"):
            return self.spark.createDataFrame([], TABLES["ref_watermark"])
        runs = self.spark.read.schema("run string, place long").json(f"{self.path}/committed")
        rows = self.spark.read.schema(TABLES["ref_watermark"] + ", run string").parquet(f"{self.path}/ref_watermark").join(runs, "run")
        keys = ["repo_id", "policy_hash", "start_set_id", "ref"]
        return rows.groupBy(*keys).agg(F.max_by("tip", "place").alias("tip"))

    def persist(self, tables: dict[str, DataFrame], complete: bool) -> str:
        """Write a run's rows; watermarks only if it is complete; then its marker."""
        run = uuid.uuid4().hex
        for name in ("blob_ctx", "finding", "seen_blob", *(["ref_watermark"] if complete else [])):
            if name in tables:
                rows = tables[name]
                columns = [(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in (c.split() for c in TABLES[name].split(", "))]
                rows.select(*columns, F.lit(run).alias("run")).write.mode("append").parquet(f"{self.path}/{name}")
        self._commit(run)
        return run

    def _commit(self, run: str) -> None:
        """Write the run's marker under the next free number; two runs can't take the same one."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/committed")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        place = 1 + max((int(n) for f in fs.listStatus(folder) if (n := f.getPath().getName().removesuffix(".json")).isdigit()), default=-1)
        while True:
            try:
                out = fs.create(jvm.org.apache.hadoop.fs.Path(folder, f"{place:012}.json"), False)
                break
            except Py4JJavaError:
                if not fs.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{place:012}.json")):
                    raise
                place += 1
        out.write(bytearray(json.dumps({"run": run, "place": place}).encode() + b"\n"))
        out.close()


def finalize(repo_id: str, policy: str, contexts: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """The rows of a run: the smallest context and the distinct findings of each blob, and what is seen now."""
    key = [F.lit(repo_id).alias("repo_id"), F.lit(policy).alias("policy_hash")]
    order = [c for c in ("commit_id", "path", "parent_idx", "change", "mode", "path_class") if c in contexts.columns]
    smallest = contexts.groupBy("oid").agg(F.min(F.struct(*order)).alias("m"))
    findings = found.select(*key, "oid", F.col("root_start").alias("start"), F.col("root_end").alias("end"), "rule_id", "norm_hash").distinct()
    return {"blob_ctx": smallest.select(*key, "oid", "m.*"), "finding": findings, "seen_blob": smallest.select(*key, "oid")}
