"""Archives as objects: gzip, tar, tar.gz and zip expanded within budgets.

One archive is one unit of work: its budgets are sequential. Each entry becomes a row
with a canonical virtual path; what is skipped or cut short becomes a row with a
reason and no content, so counts of outcomes are an aggregation.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, content binary, outcome string, reason string"
SUFFIXES = ((".tar.gz", "targz"), (".tgz", "targz"), (".tar", "tar"), (".gz", "gzip"), (".zip", "zip"))


@dataclass(frozen=True)
class Budgets:
    """Fixed defaults: nesting, entries, bytes of an entry, an archive and a root, bytes of names and headers, inflation ratio."""

    depth: int = 3
    entries: int = 4096
    entry_bytes: int = 64 << 20
    archive_bytes: int = 256 << 20
    root_bytes: int = 512 << 20
    metadata_bytes: int = 16 << 20
    ratio: int = 128
    encrypted: str = "skip"  # or "fail"


class Stop(Exception):
    """Ends an archive; the reason is its outcome."""


def detect(path: str, content: bytes) -> str | None:
    """By suffix first, then by magic."""
    low = path.lower()
    for suffix, kind in SUFFIXES:
        if low.endswith(suffix):
            return kind
    if content[:2] == b"\x1f\x8b":
        return "gzip"
    if content[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    return "tar" if content[257:262] == b"ustar" else None


def fnv64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def virtual_path(root: str, name: bytes, locator: str, most: int = 4096, components: int = 256) -> str:
    """``root::entry@locator``: slashes one way, no ``.``, ``..`` clamped at the top, odd bytes as %HH, long names cut with a hash."""
    parts: list[bytes] = []
    for x in name.replace(b"\\", b"/").split(b"/"):
        if x == b"..":
            del parts[-1:]
        elif x not in (b"", b"."):
            parts.append(x)
    entry = "/".join("".join(chr(b) if 0x20 <= b < 0x7F and b != 0x25 else f"%{b:02X}" for b in x) for x in parts[:components]) or "<empty>"
    if len(entry) > most or len(parts) > components:
        entry = f"{entry[: most - 18]}~#{fnv64(name):016x}"
    return f"{root}::{entry}@{locator}"


def _inflate(data: bytes, wbits: int, least: int) -> tuple[bytes, bool]:
    """(bytes, whole): up to ``least`` + 1 bytes; whole is False on corrupt or truncated input."""
    d, out = zlib.decompressobj(wbits), b""
    try:
        out = d.decompress(data, least + 1)
        return out, d.eof or len(out) > least
    except zlib.error:
        d, out = zlib.decompressobj(wbits), bytearray()
        for k in range(0, len(data), 512):  # what is readable before the fault
            try:
                out += d.decompress(data[k : k + 512], least + 1 - len(out))
            except zlib.error:
                break
        return bytes(out), False


class Expander:
    """Rows of one root archive: (path, content or None, outcome, reason)."""

    def __init__(self, budgets: Budgets):
        self.b, self.root_left = budgets, budgets.root_bytes

    def expand(self, path: str, kind: str, data: bytes, depth: int = 1):
        if depth > self.b.depth:
            yield path, None, "skipped", "depth_exceeded"
            return
        try:
            yield from {"gzip": self._gzip, "tar": self._tar, "targz": self._targz, "zip": self._zip}[kind](path, data, depth)
        except Stop as e:
            yield path, None, "partial", str(e)
        except (ValueError, IndexError, struct.error, zlib.error, OverflowError):
            yield path, None, "partial", f"malformed_{kind}"  # no input fails a job

    def _charge(self, size: int, left: int, packed: int | None = None) -> int:
        if packed is not None and size > max(packed, 1) * self.b.ratio:
            raise Stop("inflation_ratio_exceeded")
        if size > left:
            raise Stop("archive_output_budget_exceeded")
        self.root_left -= size
        if self.root_left < 0:
            raise Stop("root_output_budget_exceeded")
        return left - size

    def _entry(self, path: str, name: bytes, data: bytes, depth: int):
        """An entry's bytes, or what a nested archive holds; a zip inside is scanned as bytes, for it needs random access."""
        kind = detect(name.decode("latin-1"), data)
        if kind in ("gzip", "tar", "targz"):
            yield from self.expand(path, kind, data, depth + 1)
            return
        if kind == "zip":
            yield path, None, "skipped", "needs_random_access_no_spill"
        yield path, data, "scanned", None

    def _members(self, data: bytes, least: int) -> tuple[bytes, bool]:
        """(bytes, whole) of all members of a gzip stream, up to ``least`` + 1 bytes; zeros after the last are padding."""
        out, whole = bytearray(), True
        while whole and len(out) <= least and data.rstrip(b"\0"):
            d = zlib.decompressobj(31)
            try:
                out += d.decompress(data, least + 1 - len(out))
                whole, data = d.eof or len(out) > least, d.unused_data
            except zlib.error:
                part, whole = _inflate(data, 31, least - len(out))
                out += part
        return bytes(out), whole

    def _gzip(self, path, data, depth):
        vpath = virtual_path(path, b"<gunzip>", f"g{0:016x}")
        most = self.b.ratio * max(1, len(data))
        out, whole = self._members(data, min(self.b.entry_bytes, most))
        over = "inflation_ratio_exceeded" if len(out) > most else "entry_output_budget_exceeded" if len(out) > self.b.entry_bytes else None
        out = out[: min(self.b.entry_bytes, most)]
        self._charge(len(out), self.b.archive_bytes)
        if out:
            yield vpath, out, "scanned", None
        if over or not whole or not data:
            yield vpath, None, "partial", over or "gzip_corrupt"

    def _targz(self, path, data, depth):
        most = self.b.ratio * max(1, len(data))
        out, whole = self._members(data, min(self.b.archive_bytes, most))
        over = "inflation_ratio_exceeded" if len(out) > most else "archive_output_budget_exceeded" if len(out) > self.b.archive_bytes else None
        yield from self._tar(path, out, depth)
        if over or not whole:
            yield path, None, "partial", over or "gzip_corrupt"

    def _tar(self, path, data, depth):
        at, entries, metadata, left, long_name = 0, 0, 0, self.b.archive_bytes, None
        while at + 512 <= len(data):
            head = data[at : at + 512]
            if not head.strip(b"\0"):
                return
            block = at // 512
            try:
                size = int.from_bytes(head[125:136], "big") if head[124] & 0x80 else int(head[124:136].strip(b"\0 ") or b"0", 8)
                told = int(head[148:156].strip(b"\0 ") or b"0", 8)
            except ValueError:
                raise Stop("malformed_tar") from None
            if told != sum(head[:148]) + 8 * 32 + sum(head[156:]):
                raise Stop("malformed_tar")
            body, at = data[at + 512 : at + 512 + size], at + 512 + -(-size // 512) * 512
            if len(body) < size:
                raise Stop("malformed_tar")
            kind = head[156:157]
            name = head[:100].split(b"\0")[0]
            if head[257:262] == b"ustar" and (prefix := head[345:500].split(b"\0")[0]):
                name = prefix + b"/" + name
            if kind in (b"L", b"x", b"g", b"K"):
                metadata += size
                if metadata > self.b.metadata_bytes:
                    raise Stop("metadata_budget_exceeded")
                if kind == b"L":
                    long_name = body.split(b"\0")[0]
                elif kind == b"x":
                    k = 0
                    # A record is its own length, a space, key=value and a line end; one that can't be ends the list.
                    while (space := body.find(b" ", k, k + 20)) > k and body[k:space].isdigit() and space + 1 < (end := k + int(body[k:space])) <= len(body):
                        if body[space + 1 : end].startswith(b"path="):
                            long_name = body[space + 6 : end - 1]
                        k = end
                continue
            name, long_name = long_name or name, None
            entries += 1
            if entries > self.b.entries:
                raise Stop("entry_count_exceeded")
            vpath = virtual_path(path, name, f"t{block:016x}")
            if kind not in (b"0", b"\0", b"7"):
                yield vpath, None, "skipped", "non_regular"
            elif size > self.b.entry_bytes:
                left = self._charge(0, left)
                yield vpath, body[: self.b.entry_bytes], "scanned", None
                yield vpath, None, "partial", "entry_output_budget_exceeded"
            else:
                left = self._charge(size, left)
                yield from self._entry(vpath, name, body, depth)

    def _zip(self, path, data, depth):
        end = data.rfind(b"PK\x05\x06")
        if end < 0 or end + 22 > len(data):
            raise Stop("malformed_zip")
        many, size, at = struct.unpack("<HII", data[end + 10 : end + 20])
        if many == 0xFFFF or at == 0xFFFFFFFF:
            yield path, None, "skipped", "unsupported_feature"
            return
        if size > self.b.metadata_bytes:
            raise Stop("metadata_budget_exceeded")
        left = self.b.archive_bytes
        for n in range(many):
            head = data[at : at + 46]
            if len(head) < 46 or head[:4] != b"PK\x01\x02":
                raise Stop("malformed_zip")
            flags, method = struct.unpack("<HH", head[8:12])
            packed, full, names, extra, comment = struct.unpack("<IIHHH", head[20:34])
            local = struct.unpack("<I", head[42:46])[0]
            name = data[at + 46 : at + 46 + names]
            valid = data[local : local + 4] == b"PK\x03\x04" and local + 30 <= len(data)
            vpath = virtual_path(path, name, f"z{local:016x}" if valid else f"c{at:016x}")
            at += 46 + names + extra + comment
            if n >= self.b.entries:
                raise Stop("entry_count_exceeded")
            if name.endswith(b"/"):
                yield vpath, None, "skipped", "non_regular"
            elif flags & 1:
                if self.b.encrypted == "fail":
                    raise Stop("encrypted_entry")
                yield vpath, None, "skipped", "encrypted_entry"
            elif method not in (0, 8):
                yield vpath, None, "skipped", "unsupported_compression"
            elif not valid:
                yield vpath, None, "skipped", "corrupt_entry"
            else:
                start = local + 30 + sum(struct.unpack("<HH", data[local + 26 : local + 30]))
                raw = data[start : start + packed]
                body, whole = (raw[: self.b.entry_bytes], len(raw) == full) if method == 0 else _inflate(raw, -15, self.b.entry_bytes)
                left = self._charge(len(body), left, len(raw))
                yield from self._entry(vpath, name, body[: self.b.entry_bytes], depth)
                if len(body) > self.b.entry_bytes:
                    yield vpath, None, "partial", "entry_output_budget_exceeded"
                elif not whole:
                    yield vpath, None, "partial", "malformed_zip"


def expand(objects: DataFrame, budgets: Budgets = Budgets(), *, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, content, outcome, reason): objects that aren't archives as they are, archives as their entries."""

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("outcome", pa.string()), ("reason", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind = detect(path or "", content or b"")
                found = Expander(budgets).expand(path, kind, content or b"") if kind else [(path, content, "scanned", None)]
                for row in found:
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return objects.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content")).mapInArrow(run, SCHEMA)


def outcomes(expanded: DataFrame) -> DataFrame:
    """Counts by outcome and reason."""
    return expanded.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))
