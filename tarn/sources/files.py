"""Files as objects, hidden ones too, as a Python data source: ``tarn_files``.

The driver lists directories only; tasks read the files of their part of the list, cut
by bytes. Stores that only Hadoop can open go through Spark's own ``binaryFile``.
"""

from __future__ import annotations

import fnmatch
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file, and of one that is an archive, which has budgets of its own.
MAX_FILE, MAX_ARCHIVE = 100 << 20, 512 << 20


@dataclass
class FilePart(InputPartition):
    files: tuple[bytes, ...]


def _ignore_rule(line: str):
    """(pattern of the path below the file's folder, whether it keeps, whether for folders alone) of a line of a .gitignore, or None."""
    rule = line.rstrip("\n").rstrip("\r")
    rule = rule if rule.endswith("\\ ") else rule.rstrip(" ")
    if not rule or rule.startswith("#"):
        return None
    keep = rule.startswith("!")
    rule = rule[1:] if keep or rule.startswith(("\\#", "\\!")) else rule
    folders = rule.endswith("/")
    rule = rule.rstrip("/")
    parts, out = rule.lstrip("/").split("/"), ""
    if "/" not in rule:
        out = "(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:.*/)?"
        else:
            # fnmatch's own translation, with stars and marks that stop at slashes.
            body = fnmatch.translate(part).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z")
            out += re.sub(r"(?<!\\)\.\*\??|\(\?>\.\*\?(.*?)\)", lambda m: "[^/]*" + (m[1] or ""), body).replace("(?s:.)", "[^/]") + ("" if last else "/")
    return re.compile(out, re.DOTALL), keep, folders


def ignored(rules: list[tuple[str, list]], path: str, is_dir: bool) -> bool:
    """Git's ignore rules of the folders above a path, outermost first, as (folder, rules): the last that fits decides."""
    out = False
    for folder, own in rules:
        below = path[len(folder) :]
        for pattern, keep, folders in own:
            if (is_dir or not folders) and pattern.fullmatch(below):
                out = not keep
    return out


def walk(root: str, *, skip_hidden: bool = False, respect_gitignore: bool = False, follow_symlinks: bool = False):
    """(path, size) of the files below ``root``, or of ``root`` itself, size None if it can't be told; a missing root is an error."""
    if os.path.isfile(root):
        yield root, os.path.getsize(root)
        return
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    known: dict[str, list] = {"": []}
    seen = {os.path.realpath(root)}
    for folder, folders, names in os.walk(root, followlinks=follow_symlinks):
        relative = os.path.relpath(folder, root)
        prefix = "" if relative == "." else f"{relative}/"
        rules = known.pop(prefix, [])
        if respect_gitignore and ".gitignore" in names:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="surrogateescape") as f:
                rules = [*rules, (prefix, [r for x in f if (r := _ignore_rule(x))])]
        folders[:] = sorted(d for d in folders if not (skip_hidden and d.startswith(".")) and not ignored(rules, prefix + d, True))
        if follow_symlinks:  # a link to a folder above would lead round for ever
            folders[:] = [d for d in folders if (real := os.path.realpath(os.path.join(folder, d))) not in seen and not seen.add(real)]
        known |= {f"{prefix}{d}/": rules for d in folders}
        for n in sorted(names):
            full = os.path.join(folder, n)
            if (skip_hidden and n.startswith(".")) or ignored(rules, prefix + n, False) or (os.path.islink(full) and not follow_symlinks) or not os.path.isfile(full):
                continue
            try:
                yield full, os.path.getsize(full)
            except OSError:
                yield full, None


def shown(path: str) -> str:
    """A path as text: bytes that aren't UTF-8 as \\xHH."""
    return os.fsencode(path).decode("utf-8", "backslashreplace")


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        on = lambda k, d="false": options.get(k, d).lower() == "true"
        self.switches = {"skip_hidden": on("skipHidden"), "respect_gitignore": on("respectGitignore"), "follow_symlinks": on("followSymlinks")}
        self.most = int(options.get("maxFileSize", MAX_FILE))
        self.most_archive = max(self.most, int(options.get("maxArchiveSize", MAX_ARCHIVE)))
        self.part = int(options.get("partitionBytes", 32 << 20))

    def partitions(self):
        parts, own, size = [], [], 0
        for path, n in walk(self.root, **self.switches):
            if n == 0:
                continue
            own.append(os.fsencode(path))
            size += min(n or 0, self.most_archive)
            if size >= self.part:
                parts.append(FilePart(tuple(own)))
                own, size = [], 0
        return [*parts, FilePart(tuple(own))]

    def read(self, partition: FilePart):
        from tarn.sources.archives import detect

        for raw in partition.files:
            path = os.fsdecode(raw)
            name = shown(path)
            try:
                size = os.path.getsize(path)
                with open(path, "rb") as f:
                    # What is an archive is told before its size counts.
                    most = self.most if size <= self.most or detect(name, f.read(512)) is None else self.most_archive
                    f.seek(0)
                    content = f.read(most + 1)
            except FileNotFoundError:
                yield name, raw, None, None, "gone"
            except PermissionError:
                yield name, raw, None, None, "permission_denied"
            except OSError:
                yield name, raw, None, None, "io_error"
            else:
                yield (name, raw, len(content), content, None) if len(content) <= most else (name, raw, size, None, "over_size_cap")


class FilesSource(DataSource):
    @classmethod
    def name(cls):
        return "tarn_files"

    def schema(self):
        return "path string, path_bytes binary, length long, content binary, reason string"

    def reader(self, schema):
        return Reader(self.options)


def files(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(path, path_bytes, length, content, reason) of all files below a path; those that can't be read or are too large have a reason and no content."""
    if "://" in path and not path.startswith("file://"):
        most = int(options.get("maxFileSize", MAX_FILE))
        # Listed apart from their content, so a large file is never read; hidden names, which Spark's listing leaves out, need a mounted path.
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
        columns = ["path", F.encode("path", "UTF-8").alias("path_bytes"), "length"]
        small = found.where(F.col("length") <= most).select(*columns, "content", F.lit(None).cast("string").alias("reason"))
        large = found.where(F.col("length") > most).select(*columns, F.lit(None).cast("binary").alias("content"), F.lit("over_size_cap").alias("reason"))
        return small.unionAll(large)
    spark.dataSource.register(FilesSource)
    reader = spark.read.format("tarn_files").option("path", path.removeprefix("file://"))
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()


def entries(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(path, content, outcome, reason): files and what archives hold; what is skipped, cut or unreadable has a reason."""
    from tarn.sources.archives import expand

    found = files(spark, path, **options)
    lost = found.where("content is null").select("path", "content", F.lit("skipped").alias("outcome"), "reason")
    return expand(found.where("content is not null")).unionAll(lost)


def scan_path(spark: SparkSession, path: str, rules=None, observation: Observation | None = None, **options: object) -> DataFrame:
    """Findings below a path, archives expanded; an ``observation`` counts scanned objects, their bytes, and what was skipped or cut."""
    from tarn.operators.scan import scan

    found = entries(spark, path, **options)
    if observation is not None:
        whole = F.col("content").isNotNull()
        found = found.observe(observation, F.count_if(whole).alias("objects"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("bytes"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "partial").alias("partial"))
    return scan(found.where("content is not null"), rules, id_col="path")
