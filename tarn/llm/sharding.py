"""Sharding by size-tiered compaction with versioned manifests.

Arrivals are appended as small immutable shards. Shards belong to tiers by size: each
tier holds shards up to ``fanout`` times as large as the one below. When a tier has
``fanout`` shards or more, they are merged: one job reads them in partitions of the
target size and writes a file for each, without a shuffle. A store's state is a
manifest: the list of its shards. Each change writes a manifest of the next version
under a name that nobody else can take (a rename that fails if the name exists), so a
reader sees a whole version or the one before, and of two writers the later one
starts again. That needs a file system whose rename is atomic and fails on an existing
name, as HDFS and local ones do; object stores without one need a committer of their own.
Shards that no kept version names are deleted by ``vacuum``, and so are files of commits
that failed, once they are a day old.

Defined results: rows come back as they were, in no order, nulls, ties, repeated rows
and very long texts too; an empty arrival adds no shard but a version, and a store of
empty arrivals is an empty table; columns keep their names and types whatever they are,
and an arrival with other columns is an error; a store without versions can't be read.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, *, target_bytes: int = 256 << 20, fanout: int = 4, smallest_bytes: int = 1 << 20):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fanout, self.smallest = target_bytes, fanout, smallest_bytes
        self.jvm = spark.sparkContext._jvm
        self.hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    # Hadoop's file systems, whatever the path is in

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.hadoop)

    def _list(self, name: str) -> list[tuple[str, int]]:
        where = self._path(name)
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs().listStatus(where)) if self._fs().exists(where) else []

    # manifests

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n, _ in self._list("manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None:
            if not known:
                return {"version": 0, "shards": [], "schema": None}
            version = known[-1]
        stream = self._fs().open(self._path(f"manifests/v{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, shards: list[dict], why: str, schema: str | None = None) -> dict:
        """Publish the version after ``base``, all at once, or raise Conflict."""
        if schema is not None and base["schema"] not in (None, schema):
            raise ValueError("the arrival's columns aren't those of the store")
        new = {"version": base["version"] + 1, "why": why, "shards": shards, "schema": schema or base["schema"]}
        draft, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{new['version']:012d}.json")
        out = self._fs().create(draft, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if self.path.find("://") > 0 else self._fs().getUri(), self.hadoop)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs().makeQualified(draft), self._fs().makeQualified(final), none)
        except Exception as e:
            self._fs().delete(draft, False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {new['version']}") from e
            raise
        return new

    def _retry(self, change, why: str, schema: str | None = None) -> dict | None:
        """Commit ``change(shards)`` on the newest version, again on a newer one after a conflict; nothing if the change is None."""
        while True:
            base = self.manifest()
            shards = change(base["shards"])
            if shards is None:
                return None
            try:
                return self._commit(base, shards, why, schema)
            except Conflict:
                continue

    # data

    def _written(self, folder: str) -> list[dict]:
        return [{"file": f"{folder}/{n}", "bytes": size} for n, size in self._list(folder) if n.startswith("part-")]

    def append(self, arrivals: DataFrame) -> dict:
        """Add the rows as new shards, one for each of their partitions."""
        folder, schema = f"data/{uuid.uuid4().hex}", _plain(arrivals.schema)
        if self.manifest()["schema"] not in (None, schema):
            raise ValueError("the arrival's columns aren't those of the store")
        arrivals.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return self._retry(lambda shards: shards + self._written(folder), "append", schema)

    def append_batches(self, arrivals: DataFrame, batch_col: str) -> list[dict]:
        """Add several arrivals at one reading, a version for each value of ``batch_col`` in order."""
        folder = f"data/{uuid.uuid4().hex}"
        arrivals.write.option("compression", "zstd").partitionBy(batch_col).parquet(f"{self.path}/{folder}")
        schema = _plain(arrivals.drop(batch_col).schema)
        batches = [f"{folder}/{d}" for d, _ in self._list(folder) if d.startswith(f"{batch_col}=")]
        return [self._retry(lambda shards, d=d: shards + (self._written(d) if d else []), "append", schema) for d in batches or [None]]

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)) + 1) if size >= self.smallest else 0

    def due(self, shards: list[dict]) -> list[dict]:
        """The shards of the lowest tier with enough of them below the target size."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] <= self.target // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return next((own for _, own in sorted(tiers.items()) if len(own) >= self.fanout), [])

    def compact(self) -> list[dict]:
        """Merge tiers until none is due; a version for each merge."""
        out = []
        while own := self.due(self.manifest()["shards"]):
            folder = f"data/{uuid.uuid4().hex}"
            # A session of its own: its partitions are as large as the files to write.
            reader = self.spark.newSession()
            reader.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
            reader.conf.set("spark.sql.files.openCostInBytes", "0")
            reader.conf.set("spark.sql.files.minPartitionNum", "1")
            self._read(own, reader).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
            gone = {s["file"] for s in own}
            new = self._written(folder)

            def swap(shards: list[dict], gone=gone, new=new) -> list[dict] | None:
                # Another compaction may have taken some of them; then these files are left to ``vacuum``.
                return [s for s in shards if s["file"] not in gone] + new if gone <= {s["file"] for s in shards} else None

            if (done := self._retry(swap, "compact")) is None:
                continue
            out.append(done)
            if len(new) >= len(own):
                break  # the reader doesn't merge files here
        return out

    def _read(self, shards: list[dict], spark: SparkSession | None = None, version: int | None = None) -> DataFrame:
        reader = (spark or self.spark).read.schema(StructType.fromJson(json.loads(self.manifest(version)["schema"])))
        return reader.parquet(*[f"{self.path}/{s['file']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        known = self.manifest(version)
        if known["schema"] is None:
            raise ValueError("the store has no versions")
        if not known["shards"]:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(known["schema"])))
        return self._read(known["shards"], version=version)

    def vacuum(self, keep: int = 1, orphan_hours: float = 24) -> list[str]:
        """Delete shards that none of the last ``keep`` versions names, older manifests, and files that no version ever named once they are ``orphan_hours`` old."""
        known = self.versions()
        named = {v: {s["file"] for s in self.manifest(v)["shards"]} for v in known}
        used = set().union(*(named[v] for v in known[-keep:]))
        gone = sorted(set().union(*(named[v] for v in known[:-keep])) - used)
        latest, files = (time.time() - orphan_hours * 3600) * 1000, self._fs().listFiles(self._path("data"), True) if self._fs().exists(self._path("data")) else None
        root = self._fs().makeQualified(self._path("data")).toString()
        while files is not None and files.hasNext():
            f = files.next()
            name = "data" + f.getPath().toString().removeprefix(root)
            if f.getModificationTime() < latest and not any(name in x for x in named.values()):
                gone.append(name)
        for f in gone:
            self._fs().delete(self._path(f), False)
        for v in known[:-keep]:
            self._fs().delete(self._path(f"manifests/v{v:012d}.json"), False)
        return gone


def _plain(schema: StructType) -> str:
    """The schema as JSON, every column nullable, as Parquet has them."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema]).json()


def shard_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", batches: int = 4, target_bytes: int = 64 << 20) -> Store:
    """Append ``docs`` in arrivals by a hash of the id, compact, and drop what the last version doesn't name."""
    store = Store(docs.sparkSession, path, target_bytes=target_bytes)
    batch = "arrival_batch_of_store"
    while batch in {c.lower() for c in docs.columns}:
        batch += "_"
    store.append_batches(docs.withColumn(batch, F.pmod(F.xxhash64(docs[id_col]), F.lit(batches))), batch)
    store.compact()
    store.vacuum()
    return store
