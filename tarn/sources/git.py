"""Git repositories as tables: loose and packed objects, commits, tree entries, refs.

A pack is one partition, so that the bases of its deltas are near; objects are decoded
by the format's own rules, without a git program.
"""

from __future__ import annotations

import glob
import hashlib
import os
import re
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
MODES = {"40000": "tree", "040000": "tree", "100644": "file", "100664": "file", "100755": "executable", "120000": "symlink", "160000": "gitlink"}


@dataclass
class Part(InputPartition):
    kind: str
    path: str


def git_dir(repo: str) -> str:
    """Of a worktree, a bare repository or a linked worktree."""
    at = os.path.join(repo, ".git")
    if os.path.isfile(at):
        with open(at, encoding="utf-8") as f:
            at = os.path.join(repo, f.read().split("gitdir:", 1)[1].strip())
    elif not os.path.isdir(at):
        at = repo
    common = os.path.join(at, "commondir")
    if os.path.isfile(common):
        with open(common, encoding="utf-8") as f:
            at = os.path.normpath(os.path.join(at, f.read().strip()))
    if not os.path.isdir(os.path.join(at, "objects")):
        raise FileNotFoundError(f"no repository at {repo}")
    return at


def refs(repo: str) -> list[tuple[str, str]]:
    """(name, object id) of all refs; loose ones go before packed ones."""
    at, out = git_dir(repo), {}
    packed = os.path.join(at, "packed-refs")
    if os.path.exists(packed):
        with open(packed, encoding="utf-8") as f:
            for line in f:
                if m := re.fullmatch(r"([0-9a-f]{40}|[0-9a-f]{64}) (\S+)\s*", line):
                    last = m[2]
                    out[last] = m[1]
                elif m := re.fullmatch(r"\^([0-9a-f]{40}|[0-9a-f]{64})\s*", line):
                    out[last] = m[1]  # what the annotated tag above is of
    for path in glob.glob(os.path.join(at, "refs", "**"), recursive=True):
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                text = f.read().strip()
            if re.fullmatch("[0-9a-f]{40}|[0-9a-f]{64}", text):
                out[os.path.relpath(path, at)] = text
    return sorted(out.items())


def start_set(repo: str, which: str = "default", explicit: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Refs to scan: ``default`` branch, ``remotes``, ``branches_and_tags`` or ``explicit`` ones."""
    known = refs(repo)
    if which == "default":
        with open(os.path.join(git_dir(repo), "HEAD"), encoding="utf-8") as f:
            head = f.read().strip()
        name = head.removeprefix("ref: ")
        return [(n, o) for n, o in known if n == name] or ([("HEAD", head)] if name == head else [])
    starts = {"remotes": ("refs/remotes/",), "branches_and_tags": ("refs/heads/", "refs/tags/")}
    return [(n, o) for n, o in known if n in explicit] if which == "explicit" else [(n, o) for n, o in known if n.startswith(starts[which])]


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """Copy and insert instructions of a git delta."""
    at = 0

    def size() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = delta[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    if size() != len(base):
        raise ValueError("the delta is for another base")
    want, out = size(), bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            start = length = 0
            for k in range(7):
                if op >> k & 1:
                    if k < 4:
                        start |= delta[at] << 8 * k
                    else:
                        length |= delta[at] << 8 * (k - 4)
                    at += 1
            length = length or 0x10000
            if start + length > len(base):
                raise ValueError("a copy beyond the base")
            out += base[start : start + length]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("a reserved instruction")
    if len(out) != want:
        raise ValueError("the delta gives another size")
    return bytes(out)


def parse_index(data: bytes, wide: int = 20) -> list[tuple[str, int]]:
    """(object id, offset) of a version 2 pack index with ids of ``wide`` bytes."""
    if data[:8] != b"\xfftOc\0\0\0\2":
        raise ValueError("not a version 2 index")
    n = struct.unpack(">I", data[8 + 255 * 4 : 8 + 256 * 4])[0]
    at = 8 + 1024
    ids = [data[at + wide * k : at + wide * (k + 1)].hex() for k in range(n)]
    at += (wide + 4) * n
    offsets = struct.unpack(f">{n}I", data[at : at + 4 * n])
    large = at + 4 * n
    return [(i, o if o < 1 << 31 else struct.unpack(">Q", data[large + 8 * (o & 0x7FFFFFFF) :][:8])[0]) for i, o in zip(ids, offsets, strict=True)]


def parse_multi_index(data: bytes, wide: int = 20) -> list[tuple[str, str, int]]:
    """(object id, pack, offset) of a version 1 multi-pack index."""
    if data[:4] != b"MIDX" or data[4] != 1 or data[5] != (1 if wide == 20 else 2):
        raise ValueError("not a version 1 multi-pack index of these ids")
    chunks = {data[12 + 12 * k : 16 + 12 * k]: struct.unpack(">Q", data[16 + 12 * k : 24 + 12 * k])[0] for k in range(data[6])}
    packs = [n.decode().rsplit(".", 1)[0] + ".pack" for n in data[chunks[b"PNAM"] :].split(b"\0", struct.unpack(">I", data[8:12])[0])[:-1]]
    n = struct.unpack(">I", data[chunks[b"OIDF"] + 255 * 4 :][:4])[0]
    ids, places, large = chunks[b"OIDL"], chunks[b"OOFF"], chunks.get(b"LOFF")
    out = []
    for k in range(n):
        pack, offset = struct.unpack(">II", data[places + 8 * k : places + 8 * k + 8])
        if large is not None and offset >> 31:
            offset = struct.unpack(">Q", data[large + 8 * (offset & 0x7FFFFFFF) :][:8])[0]
        out.append((data[ids + wide * k : ids + wide * (k + 1)].hex(), packs[pack], offset))
    return out


def _inflate(data: bytes, at: int, step: int = 64 << 10) -> bytes:
    """The zlib stream that begins at ``at``, read in steps; the rest of the pack isn't copied."""
    d, out, view = zlib.decompressobj(), [], memoryview(data)
    while not d.eof:
        piece = view[at : at + step]
        if not piece:
            raise ValueError("a truncated object")
        out.append(d.decompress(piece))
        at += step
    return b"".join(out)


#: Bytes of decoded objects that a pack's task keeps as bases.
CACHE_BYTES = 256 << 20


class Pack:
    def __init__(self, path: str, external=None, wide: int = 20):
        with open(path, "rb") as f:
            self.data = f.read()
        if self.data[:4] != b"PACK":
            raise ValueError("not a pack")
        with open(path[:-5] + ".idx", "rb") as f:
            self.index = dict(parse_index(f.read(), wide))
        self.external, self.wide = external, wide
        self.cache: dict[int, tuple[str, bytes]] = {}
        self.held = 0

    def _entry(self, offset: int) -> tuple[int, int, int | str | None]:
        """(kind, where the zlib stream begins, the base's offset or id)."""
        k, b = offset + 1, self.data[offset]
        kind = b >> 4 & 7
        while b & 128:
            b = self.data[k]
            k += 1
        if kind == 6:
            b = self.data[k]
            back, k = b & 127, k + 1
            while b & 128:
                b = self.data[k]
                back, k = (back + 1) << 7 | b & 127, k + 1
            return kind, k, offset - back
        if kind == 7:
            oid = self.data[k : k + self.wide].hex()
            return kind, k + self.wide, self.index.get(oid, oid)
        return kind, k, None

    def at(self, offset: int) -> tuple[str, bytes]:
        """The object at ``offset``; chains of deltas of any length are followed to their base and built up from there."""
        chain, seen, at = [], set(), offset
        while at not in self.cache:
            if at in seen:
                raise ValueError("a delta chain that leads to itself")
            seen.add(at)
            kind, body, base = self._entry(at)
            chain.append((at, body))
            if base is None:
                chain.pop()
                self._keep(at, (TYPES[kind], _inflate(self.data, body)))
                break
            if isinstance(base, str):
                out = self.external(base)
                break
            at = base
        if not (chain and isinstance(base, str)):
            out = self.cache[at]
        for place, body in reversed(chain):
            out = (out[0], apply_delta(out[1], _inflate(self.data, body)))
            self._keep(place, out)
        return out

    def _keep(self, offset: int, found: tuple[str, bytes]) -> None:
        if len(self.cache) > 2000 or self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        self.cache[offset] = found
        self.held += len(found[1])


def loose(path: str) -> tuple[str, bytes]:
    with open(path, "rb") as f:
        head, _, body = zlib.decompress(f.read()).partition(b"\0")
    return head.split()[0].decode(), body


def object_dirs(objects: str) -> list[str]:
    """A folder of objects and its alternates, each once."""
    out = [os.path.normpath(objects)]
    for at in out:
        listed = os.path.join(at, "info", "alternates")
        if os.path.isfile(listed):
            with open(listed, encoding="utf-8", errors="surrogateescape") as f:
                out += [x for line in f if (p := line.strip()) and not p.startswith("#") and (x := os.path.normpath(os.path.join(at, p))) not in out]
    return out


def id_bytes(repo: str) -> int:
    """20, or 32 in a repository whose configuration names SHA-256."""
    path = os.path.join(git_dir(repo), "config")
    if not os.path.isfile(path):
        return 20
    with open(path, encoding="utf-8", errors="surrogateescape") as f:
        return 32 if re.search(r"(?im)^\s*objectformat\s*=\s*sha256\s*$", f.read()) else 20


def preflight(repo: str, most_packs: int | None = None) -> dict[str, object]:
    """What a scan will meet: packs, packs without an index, commit graph and multi-pack index, and locks of a running maintenance."""
    at = git_dir(repo)
    packs = [p for d in object_dirs(os.path.join(at, "objects")) for p in glob.glob(f"{d}/pack/*.pack")]
    there = lambda *names: any(os.path.exists(os.path.join(at, "objects", n)) for n in names)
    out = {
        "packs": len(packs),
        "packs_without_index": sum(not os.path.exists(p[:-5] + ".idx") for p in packs),
        "commit_graph": there("info/commit-graph", "info/commit-graphs"),
        "multi_pack_index": there("pack/multi-pack-index"),
        "locked": [n for n in ("gc.pid", "shallow.lock", "packed-refs.lock", "objects/maintenance.lock") if os.path.exists(os.path.join(at, n))],
        "id_bytes": id_bytes(repo),
    }
    if most_packs is not None and len(packs) > most_packs:
        raise ValueError(f"{len(packs)} packs, more than {most_packs}: repack first")
    return out


class _Store:
    """Objects by id, for bases outside of a pack; indexes are read once."""

    def __init__(self, dirs: list[str], wide: int):
        self.dirs, self.wide, self.packs = dirs, wide, None

    def __call__(self, oid: str) -> tuple[str, bytes]:
        for d in self.dirs:
            path = f"{d}/{oid[:2]}/{oid[2:]}"
            if os.path.exists(path):
                return loose(path)
        if self.packs is None:
            self.packs = [Pack(p, self, self.wide) for d in self.dirs for p in sorted(glob.glob(f"{d}/pack/*.pack")) if os.path.exists(p[:-5] + ".idx")]
        for p in self.packs:
            if oid in p.index:
                return p.at(p.index[oid])
        raise KeyError(oid)


class ObjectsReader(DataSourceReader):
    def __init__(self, options):
        self.dirs = object_dirs(os.path.join(git_dir(options["path"]), "objects"))
        self.wide = id_bytes(options["path"])

    def partitions(self):
        parts = []
        for d in self.dirs:
            parts += [Part("pack", p) for p in sorted(glob.glob(f"{d}/pack/*.pack")) if os.path.exists(p[:-5] + ".idx")]
            parts += [Part("loose", p) for p in sorted(glob.glob(f"{d}/[0-9a-f][0-9a-f]"))]
        return parts or [Part("none", "")]

    def read(self, partition):
        """Objects that can't be decoded are rows of type ``broken`` without content."""
        if partition.kind == "pack":
            p = Pack(partition.path, _Store(self.dirs, self.wide), self.wide)
            name = os.path.basename(partition.path)
            for oid, offset in sorted(p.index.items(), key=lambda x: x[1]):
                try:
                    kind, body = p.at(offset)
                except (ValueError, KeyError, IndexError, zlib.error):
                    kind, body = "broken", None
                yield oid, kind, body, name, offset
        elif partition.kind == "loose":
            for n in sorted(os.listdir(partition.path)):
                if re.fullmatch("[0-9a-f]{38}|[0-9a-f]{62}", n):
                    try:
                        kind, body = loose(f"{partition.path}/{n}")
                    except (ValueError, OSError, zlib.error):
                        kind, body = "broken", None
                    yield os.path.basename(partition.path) + n, kind, body, None, None


class GitSource(DataSource):
    @classmethod
    def name(cls):
        return "tarn_git"

    def schema(self):
        return "oid string, type string, content binary, pack string, pack_offset long"

    def reader(self, schema):
        return ObjectsReader(self.options)


class IndexReader(DataSourceReader):
    """Where objects are: multi-pack indexes, and indexes of the packs that none of them covers."""

    def __init__(self, options):
        self.dirs = object_dirs(os.path.join(git_dir(options["path"]), "objects"))
        self.wide = id_bytes(options["path"])

    def partitions(self):
        parts = []
        for d in self.dirs:
            covered: set[str] = set()
            many = f"{d}/pack/multi-pack-index"
            if os.path.isfile(many):
                parts.append(Part("many", many))
                with open(many, "rb") as f:
                    data = f.read()
                covered = {pack for _, pack, _ in parse_multi_index(data, self.wide)}
            parts += [Part("one", p) for p in sorted(glob.glob(f"{d}/pack/*.idx")) if os.path.basename(p)[:-4] + ".pack" not in covered]
        return parts or [Part("none", "")]

    def read(self, partition):
        if partition.kind == "none":
            return
        with open(partition.path, "rb") as f:
            data = f.read()
        if partition.kind == "many":
            yield from parse_multi_index(data, self.wide)
        else:
            pack = os.path.basename(partition.path)[:-4] + ".pack"
            yield from ((oid, pack, offset) for oid, offset in parse_index(data, self.wide))


class IndexSource(DataSource):
    @classmethod
    def name(cls):
        return "tarn_git_index"

    def schema(self):
        return "oid string, pack string, pack_offset long"

    def reader(self, schema):
        return IndexReader(self.options)


def object_index(spark: SparkSession, repo: str) -> DataFrame:
    """(oid, pack, pack_offset) of every packed object once, without decoding any; a lookup is a join by ``oid``."""
    from tarn.operators.relational import prefer

    spark.dataSource.register(IndexSource)
    return prefer(spark.read.format("tarn_git_index").load(repo), ["oid"], F.col("pack"), F.col("pack_offset"))


def objects(spark: SparkSession, repo: str) -> DataFrame:
    """Every object once: a copy that can be decoded, of the first pack by name, or the loose one."""
    from tarn.operators.relational import prefer

    spark.dataSource.register(GitSource)
    found = spark.read.format("tarn_git").load(repo)
    return prefer(found, ["oid"], F.col("type") == "broken", F.col("pack").asc_nulls_last(), F.col("pack_offset"))


def commits(objects: DataFrame) -> DataFrame:
    """(id, tree, parents, ts)."""
    text = F.decode("content", "ISO-8859-1")
    head = F.split(text, "\n\n", 2)[0]
    parents = F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]+)"), F.lit(1))
    ts = F.regexp_extract(head, r"(?m)^committer .* (\d+) [+-]\d{4}$", 1)
    return objects.where("type = 'commit'").select(F.col("oid").alias("id"), F.regexp_extract(head, r"(?m)^tree ([0-9a-f]+)", 1).alias("tree"), parents.alias("parents"), ts.try_cast("long").alias("ts"))


def tree_entries(objects: DataFrame, oid_bytes: int = 20) -> DataFrame:
    """(tree, ord, mode, name, oid, kind) of every tree."""
    schema = pa.schema([("tree", pa.string()), ("ord", pa.int32()), ("mode", pa.string()), ("name", pa.string()), ("oid", pa.string()), ("kind", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for tree, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = n = 0
                while at < len(data):
                    space, nul = data.index(b" ", at), data.index(b"\0", at)
                    mode = data[at:space].decode()
                    rows.append((tree, n, mode, data[space + 1 : nul].decode("latin-1"), data[nul + 1 : nul + 1 + oid_bytes].hex(), MODES.get(mode, "unknown")))
                    at, n = nul + 1 + oid_bytes, n + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return objects.where("type = 'tree'").select("oid", "content").mapInArrow(run, "tree string, ord int, mode string, name string, oid string, kind string")


def object_id(kind: str, body: bytes, wide: int = 20) -> str:
    return (hashlib.sha1 if wide == 20 else hashlib.sha256)(f"{kind} {len(body)}\0".encode() + body).hexdigest()


@dataclass
class Tables:
    """A repository's objects, its commits (id, tree, parents, ts), edges between commits that are there, and tree entries."""

    objects: DataFrame
    graph: DataFrame
    edges: DataFrame
    entries: DataFrame


def tables(spark: SparkSession, repo: str) -> Tables:
    from tarn.sources.storage import materialise

    every = materialise(objects(spark, repo), "objects")
    graph = materialise(commits(every), "commits")
    links = graph.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))
    # A shallow clone names parents that it doesn't hold.
    edges = materialise(links.join(graph.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent"), "edges")
    return Tables(every, graph, edges, materialise(tree_entries(every, id_bytes(repo)), "entries"))


def tips(spark: SparkSession, repo: str, t: Tables, which: str = "default", explicit: tuple[str, ...] = ()) -> DataFrame:
    """(ref, tip) of a start set; tags are followed to what they name, refs that name no commit are left out."""
    known = spark.createDataFrame(start_set(repo, which, explicit), "ref string, tip string")
    target = F.regexp_extract(F.decode("content", "ISO-8859-1"), r"\Aobject ([0-9a-f]+)", 1)
    tags = t.objects.where("type = 'tag'").select(F.col("oid").alias("tip"), target.alias("target"))
    if not tags.isEmpty():
        for _ in range(8):  # tags of tags
            known = known.join(tags, "tip", "left").select("ref", F.coalesce("target", "tip").alias("tip"))
    return known.join(t.objects.where("type <> 'commit'").select(F.col("oid").alias("tip")), "tip", "left_anti").select("ref", "tip")


def _text_blobs(t: Tables, wanted: DataFrame) -> DataFrame:
    from tarn.functions.gates import latin1, likely_binary

    return t.objects.where("type = 'blob'").join(wanted.select("oid"), "oid", "left_semi").where(~likely_binary(latin1(F.col("content"))))


def scan_repository(spark: SparkSession, repo: str, which: str = "default", seen: DataFrame | None = None, rules=None) -> tuple[DataFrame, DataFrame]:
    """(contexts, findings) of the blobs that commits reachable from a start set introduce; binary blobs are skipped."""
    from tarn.operators import history
    from tarn.operators.scan import scan

    t = tables(spark, repo)
    wanted = history.reachable(tips(spark, repo, t, which).select(F.col("tip").alias("id")), t.edges).join(t.graph, "id")
    order = history.generations(t.graph.select("id"), t.edges)
    files = history.flatten_trees(wanted.select(F.col("tree").alias("root")).distinct(), t.entries)
    ranked = wanted.join(order, "id").select(F.col("tree").alias("root"), F.struct("generation", "id").alias("topo"))
    first = history.first_introduction(files.join(ranked, "root").select("oid", "topo", "path")).select("oid", F.col("topo.id").alias("commit_id"), "path")
    new = first if seen is None else history.unseen(first, seen)
    return new, scan(_text_blobs(t, new), rules, id_col="oid").withColumnRenamed("object_id", "oid")


@dataclass
class Run:
    """An incremental run: its candidates' contexts, its findings (both as read back) and what became of it."""

    contexts: DataFrame
    findings: DataFrame
    complete: bool
    skipped: int
    run: str
    objects: int
    bytes: int


def scan_changes(spark: SparkSession, repo: str, state, *, repo_id: str | None = None, which: str = "default", explicit: tuple[str, ...] = (), mode: str = "history", merge_mode: str = "all_parents", path_version: int = 1, rules=None, tuning=None) -> Run:
    """Scan what a repository's refs have gained since the last complete run in ``state``.

    ``history`` compares each new commit's tree with its parents' and scans blobs that were
    never seen; ``snapshot`` compares the tips alone with the empty tree. State is kept by repository,
    policy (rules, tuning, merge mode and path version) and start set. Blobs that are named
    but missing or broken count as skipped; then the refs' watermarks stay where they were,
    and so do these blobs out of ``seen_blob``.
    """
    from tarn.functions.gates import excluded, path_class
    from tarn.functions.rules import built_in
    from tarn.operators import history
    from tarn.operators.scan import Tuning, scan
    from tarn.sources import state as kept
    from tarn.sources.storage import materialise

    own, tuning = tuple(rules) if rules is not None else None, tuning or Tuning()
    repo_id = repo_id or os.path.realpath(repo)
    policy = kept.policy_hash(own if own is not None else built_in(), tuning, path_version, merge_mode)
    start = kept.start_set_id(f"{mode}:{which}", explicit)
    t = tables(spark, repo)
    now = materialise(tips(spark, repo, t, which, explicit), "tips")
    here = (F.col("repo_id") == repo_id) & (F.col("policy_hash") == policy)
    if mode == "snapshot":
        pairs = now.join(t.graph, now.tip == t.graph.id).select(F.col("id").alias("commit_id"), F.lit(0).alias("parent_idx"), F.col("tree").alias("new"), F.lit(None).cast("string").alias("old")).distinct()
        changes = history.tree_changes(pairs, t.entries)
    else:
        marks = state.watermarks().where(here & (F.col("start_set_id") == start)).select("ref", F.col("tip").alias("watermark"))
        new = history.introduced(materialise(now.join(marks, "ref", "left"), "refs"), t.graph, t.edges)
        changes = history.candidates(new, t.graph, t.entries, merge_mode)
    found = changes.where(~excluded(F.col("path"), path_version)).withColumn("path_class", path_class(F.col("path")))
    contexts = materialise(history.unseen(found, state.read("seen_blob").where(here)), "contexts")
    blobs = t.objects.where("type = 'blob'").select("oid")
    skipped = contexts.select("oid").distinct().join(blobs, "oid", "left_anti").count()
    contexts = contexts.join(blobs, "oid", "left_semi")
    seen = Observation()
    texts = _text_blobs(t, contexts).observe(seen, F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("bytes"))
    findings = materialise(scan(texts, own, tuning, id_col="oid").withColumnRenamed("object_id", "oid"), "findings")
    rows = kept.finalize(repo_id, policy, contexts, findings)
    key = [F.lit(x).alias(n) for x, n in ((repo_id, "repo_id"), (policy, "policy_hash"), (start, "start_set_id"))]
    run = state.persist({**rows, "ref_watermark": now.select(*key, "ref", "tip")}, complete=skipped == 0)
    return Run(contexts, findings, skipped == 0, skipped, run, seen.get["objects"], seen.get["bytes"])
