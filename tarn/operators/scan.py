"""The scan: objects times rules to findings, in one Arrow pass over the objects.

Anchors of all rules are found by one automaton; hits open windows that are merged;
gates run from cheap to dear; the pattern runs in windows alone. Buffers are then
searched for encoded spans, whose decoded bytes are scanned the same way if they hold
an anchor at all, to a bounded depth. Findings are deduplicated exactly, a decoded one
before the raw one it covers.

Objects are scanned whole, or with ``Tuning.chunk_bytes`` in chunks that carry the
overlap which the rules need (``Engine.overlap``); findings whose span ends in what was
carried belong to the chunk before. Every encoded span is decoded and every finding kept:
budgets are off by default. ``BOUNDED`` has the reference's, which hold for each 64 KiB
of an object; what goes beyond them is dropped, counted in ``Engine.dropped`` and logged
by each task.

There is no shuffle: an object is one row, a finding is small, and content never
leaves the scan. Secrets are reported by their SHA-256 alone.
"""

from __future__ import annotations

import hashlib
import logging
import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import codecs
from tarn.functions.rules import Rule, built_in, portable

STEPS = "array<struct<kind:string,start:long,end:long>>"
SCHEMA = f"object_id string, rule_id int, rule string, variant string, span_start long, span_end long, root_start long, root_end long, decode_steps {STEPS}, norm_hash string"
ARROW = pa.schema(
    [("object_id", pa.string()), ("rule_id", pa.int32()), ("rule", pa.string()), ("variant", pa.string()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("root_start", pa.int64()), ("root_end", pa.int64()),
     ("decode_steps", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("norm_hash", pa.string())]
)


@dataclass(frozen=True)
class Tuning:
    merge_gap: int = 64
    max_windows: int = 16
    pressure_gap: int = 128
    max_hits: int = 2048
    #: Bytes of a UTF-16 window that are decoded at a time; all of it is.
    max_utf16_bytes: int = 64 * 1024
    max_depth: int = 3
    #: Budgets for each 64 KiB; None is none.
    max_decoded_bytes: int | None = None
    max_work_items: int | None = None
    max_findings: int | None = None
    #: Payload of a chunk; None scans objects whole. ``overlap`` None is what the rules need.
    chunk_bytes: int | None = None
    overlap: int | None = None
    utf16: bool = True
    #: Smallest encoded spans, their number in a buffer, and the gate: decoded bytes without any anchor give nothing.
    url_least: int = 16
    base64_least: int = 32
    max_spans: int | None = None
    anchors_in_decoded: bool = True
    plus_to_space: bool = False
    base64_spaces: bool = False
    only_if_none: bool = False


#: Budgets of a chunk.
BOUNDED = Tuning(max_decoded_bytes=512 * 1024, max_work_items=256, max_findings=8192, max_spans=8)


@dataclass(frozen=True)
class Finding:
    rule_id: int
    rule: str
    variant: str
    span: tuple[int, int]
    root: tuple[int, int]
    steps: tuple[tuple[str, int, int], ...]
    norm_hash: str

    def moved(self, base: int) -> Finding:
        """The finding of a chunk that begins at ``base``; only what is in the object's own bytes moves."""
        steps = tuple((k, s + base, e + base) if n == 0 else (k, s, e) for n, (k, s, e) in enumerate(self.steps))
        return replace(self, span=self.span if self.steps else (self.span[0] + base, self.span[1] + base), root=(self.root[0] + base, self.root[1] + base), steps=steps)


def entropy(data: bytes) -> float:
    """Shannon bits a byte."""
    n = len(data)
    return math.log2(n) - sum(c * math.log2(c) for c in Counter(data).values()) / n if n else 0.0


def merged(hits: list[tuple[int, int, int]], gap: int, most: int, pressure: int) -> list[tuple[int, int, int]]:
    """Windows (start, end, first anchor) merged within a gap; over ``most``, the gap doubles until they fit or are one."""
    def merge(hits, gap):
        out: list[list[int]] = []
        for s, e, h in hits:
            if out and s <= out[-1][1] + gap:
                out[-1][1], out[-1][2] = max(out[-1][1], e), min(out[-1][2], h)
            else:
                out.append([s, e, h])
        return [tuple(x) for x in out]

    out = merge(sorted(hits), gap)
    while len(out) > most and pressure < 1 << 40:
        out, pressure = merge(out, pressure), pressure * 2
    return out


def assignment_shape(window: bytes) -> bool:
    """After the first separator and its quotes or spaces come ten token characters at least."""
    return re.match(rb"[^=:>]*[=:>][ \t\"'`=>]*[A-Za-z0-9_.-]{10,}", window, re.DOTALL) is not None


def secret_span(m: re.Match, group: int | None) -> tuple[int, int]:
    """The configured group, or the first, or the match; the first that isn't empty."""
    for g in (group, 1, 0):
        if g is not None and g <= (m.re.groups or 0) and m.end(g) > m.start(g) >= 0:
            return m.span(g)
    return m.span(0)


class Engine:
    """Compiled rules; ``scan`` takes the bytes of one object."""

    def __init__(self, rules: Iterable[Rule] | None = None, tuning: Tuning = Tuning()):
        import ahocorasick

        self.rules = list(built_in() if rules is None else rules)
        self.tuning = tuning
        #: What the last scan dropped over its budgets, by kind.
        self.dropped: Counter = Counter()
        self.patterns = [re.compile(portable(r.pattern, "python").encode("latin-1")) for r in self.rules]
        self.automata = {}
        for variant, widen in (("raw", lambda a: a), ("utf16le", lambda a: bytes(x for c in a for x in (c, 0))), ("utf16be", lambda a: bytes(x for c in a for x in (0, c)))):
            table: dict[str, list[int]] = {}
            for k, r in enumerate(self.rules):
                for a in r.anchors:
                    table.setdefault(widen(a).decode("latin-1"), []).append(k)
            auto = ahocorasick.Automaton()
            for a, own in table.items():
                auto.add_word(a, (len(a), own))
            auto.make_automaton()
            self.automata[variant] = auto

    def _variants(self, data: bytes) -> list[str]:
        return ["raw", "utf16le", "utf16be"] if self.tuning.utf16 and b"\0" in data else ["raw"]

    def has_anchor(self, data: bytes) -> bool:
        text = data.decode("latin-1")
        return any(next(self.automata[v].iter(text), None) is not None for v in self._variants(data))

    def overlap(self) -> int:
        """Bytes a chunk must carry so that no window, in UTF-16 twice as wide, nor an encoded span that fits in it is cut."""
        reach = max((2 * (r.two_phase[1] if r.two_phase else r.radius) + max(map(len, r.anchors)) for r in self.rules), default=0)
        return max(2 * reach, codecs.STRETCH)

    def scan(self, data: bytes) -> list[Finding]:
        """Findings of one object, in chunks if it is larger than one."""
        size = self.tuning.chunk_bytes
        if size is None or len(data) <= size:
            return self._scan(data)
        overlap, out, dropped = self.overlap() if self.tuning.overlap is None else self.tuning.overlap, [], Counter()
        for at in range(0, len(data), size):
            base = max(0, at - overlap)
            for f in self._scan(data[base : at + size]):
                # A span that the end of the chunk before cut is decoded whole only here.
                if at == 0 or max(f.root[1], f.steps[0][2] if f.steps else 0) > at - base:
                    out.append(f.moved(base))
            dropped += self.dropped
        self.dropped = dropped
        return self._deduplicated(out)

    def _scan(self, data: bytes) -> list[Finding]:
        t, out = self.tuning, []
        queue: list[tuple[bytes, tuple, tuple[int, int] | None, codecs.Decoded | None, int]] = [(data, (), None, None, 0)]
        # Budgets are for each stretch of the object, as the reference has them for each chunk.
        spent, items, seen, dropped = Counter(), Counter(), set(), Counter()
        for buffer, steps, parent, decoded, depth in queue:
            def to_root(s: int, e: int, parent=parent, decoded=decoded) -> tuple[int, int]:
                if parent is None:
                    return s, e
                if decoded is None:
                    return parent
                x, y = decoded.span(s, e)
                return parent[0] + x, parent[0] + y

            before = len(out)
            out += self._buffer(buffer, steps, to_root)
            if depth >= t.max_depth or (t.only_if_none and len(out) > before):
                continue
            for kind, s, e, d in self._decodes(buffer, dropped):
                root = to_root(s, e)
                own = root[0] // codecs.STRETCH
                items[own] += 1
                spent[own] += len(d.data)
                if (t.max_work_items is not None and items[own] > t.max_work_items) or (t.max_decoded_bytes is not None and spent[own] > t.max_decoded_bytes):
                    dropped["decoded buffers"] += 1
                    continue
                key = (root, hashlib.blake2b(d.data, digest_size=16).digest())
                if key in seen or (t.anchors_in_decoded and not self.has_anchor(d.data)):
                    continue
                seen.add(key)
                # Spans map exactly through one layer; deeper ones point to their outermost span.
                queue.append((d.data, (*steps, (kind, s, e)), root, d if parent is None else None, depth + 1))
        kept, held = [], Counter()
        for f in self._deduplicated(out):
            held[f.root[0] // codecs.STRETCH] += 1
            if t.max_findings is None or held[f.root[0] // codecs.STRETCH] <= t.max_findings:
                kept.append(f)
            else:
                dropped["findings"] += 1
        self.dropped = dropped
        return kept

    def _decodes(self, buffer: bytes, dropped: Counter):
        t = self.tuning
        for s, e in codecs.url_spans(buffer, t.url_least, most=t.max_spans, plus=t.plus_to_space, dropped=dropped):
            yield "url_percent", s, e, codecs.url_decode(buffer[s:e], t.plus_to_space)
        for s, e in codecs.base64_spans(buffer, t.base64_least, most=t.max_spans, spaces=t.base64_spaces, dropped=dropped):
            for shift in codecs.base64_shifts(buffer[s:e], t.base64_least):
                d = codecs.base64_decode(buffer[s:e], shift)
                if d and d.data:
                    yield "base64", s, e, d

    def _buffer(self, data: bytes, steps: tuple, to_root) -> list[Finding]:
        t, out, text = self.tuning, [], data.decode("latin-1")
        for variant in self._variants(data):
            scale = 1 if variant == "raw" else 2
            hits: dict[int, list] = {}
            for last, (size, own) in self.automata[variant].iter(text):
                for k in own:
                    hits.setdefault(k, []).append((last + 1 - size, last + 1))
            for k, places in sorted(hits.items()):
                r = self.rules[k]
                if len(places) > t.max_hits:
                    places = [(places[0][0], places[-1][1])]
                radius = (r.two_phase[0] if r.two_phase else r.radius) * scale
                around = lambda x, by: (max(0, x[0] - by), min(len(data), x[1] + by), x[-1] if len(x) > 2 else x[0])
                windows = merged([around(p, radius) for p in places], t.merge_gap, t.max_windows, t.pressure_gap)
                if r.two_phase:
                    kept = [w for w in windows if any((c if scale == 1 else bytes(x for b in c for x in ((b, 0) if variant == "utf16le" else (0, b)))) in data[w[0] : w[1]] for c in r.two_phase[2])]
                    more = (r.two_phase[1] - r.two_phase[0]) * scale
                    windows = merged([around(w, more) for w in kept], t.merge_gap, t.max_windows, t.pressure_gap)
                for w in windows:
                    out += self._raw(k, data, w, steps, to_root) if scale == 1 else self._wide(k, data, w, steps, to_root, variant)
        return out

    def _matches(self, k: int, data: bytes, start: int, end: int, hint: int):
        """Matches that pass every gate: (match span, secret span, secret)."""
        r, window = self.rules[k], data[start:end]
        if r.must_contain and r.must_contain not in window:
            return
        if not all(c in window for c in r.confirm_all) or (r.keywords and not any(c in window for c in r.keywords)):
            return
        if r.assignment_shape and not assignment_shape(window):
            return
        first = max(start, hint - 64)
        piece = data[first:end]
        for m in self.patterns[k].finditer(piece):
            if r.entropy and m.end() - m.start() >= r.entropy[1] and entropy(m[0][: r.entropy[2]]) < r.entropy[0]:
                continue
            s, e = secret_span(m, r.secret_group)
            if r.same_line_assignment and not self._line(r, piece, s):
                continue
            yield (first + m.start(), first + m.end()), (first + s, first + e), piece[s:e]

    @staticmethod
    def _line(r: Rule, data: bytes, secret: int, behind: int = 256, ahead: int = 128) -> bool:
        """Whether the secret's line has a separator and a key before it; lines whose ends are out of reach pass."""
        start = data.rfind(b"\n", max(0, secret - behind), secret)
        end = data.find(b"\n", secret, secret + ahead)
        if start < 0 or end < 0:
            return True
        before = data[start + 1 : secret]
        return re.search(rb"[=:>]", before) is not None and any(a in before for a in r.anchors)

    def _finding(self, k: int, variant: str, span, root, steps, secret: bytes) -> Finding:
        return Finding(k, self.rules[k].name, variant, span, root, steps, hashlib.sha256(secret).hexdigest())

    def _raw(self, k, data, window, steps, to_root) -> list[Finding]:
        kind = steps[-1][0] if steps else "raw"
        return [self._finding(k, kind, secret, to_root(*match), steps, text) for match, secret, text in self._matches(k, data, *window)]

    def _wide(self, k, data, window, steps, to_root, variant) -> list[Finding]:
        out = []
        for parity in (0, 1):
            start = window[0] + parity
            piece = data[start : window[1]]
            d = codecs.utf16_decode_long(piece, variant == "utf16be", self.tuning.max_utf16_bytes)
            for match, secret, text in self._matches(k, d.data, 0, len(d.data), 0):
                s, e = d.span(*match)
                out.append(self._finding(k, variant, secret, to_root(start + s, start + e), (*steps, (variant, start, start + len(piece))), text))
        return out

    @staticmethod
    def _deduplicated(found: list[Finding]) -> list[Finding]:
        """One finding for each rule, place and secret; a decoded one goes before a raw one, then the longer."""
        best: dict[tuple, Finding] = {}
        for f in found:
            key = (f.rule_id, f.root[0], f.norm_hash)
            old = best.get(key)
            if old is None or (bool(f.steps), f.root[1]) > (bool(old.steps), old.root[1]):
                best[key] = f
        return sorted(best.values(), key=lambda f: (f.root, f.rule_id, f.span))


_engines: dict[object, Engine] = {}


def scan(objects: DataFrame, rules: Iterable[Rule] | None = None, tuning: Tuning = Tuning(), *, id_col: str = "object_id", content_col: str = "content") -> DataFrame:
    """Findings of ``objects`` (id, content binary or string)."""
    own = tuple(rules) if rules is not None else None

    def run(batches):
        key = (own, tuning)
        if key not in _engines:
            _engines.clear()
            _engines[key] = Engine(own, tuning)
        engine, dropped, objects_over = _engines[key], Counter(), 0
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer().to_pybytes() if content.is_valid else b""
                found = engine.scan(data)
                if engine.dropped:
                    dropped, objects_over = dropped + engine.dropped, objects_over + 1
                for f in found:
                    rows.append({"object_id": name, "rule_id": f.rule_id, "rule": f.rule, "variant": f.variant, "span_start": f.span[0], "span_end": f.span[1], "root_start": f.root[0], "root_end": f.root[1],
                                 "decode_steps": [{"kind": a, "start": b, "end": c} for a, b, c in f.steps], "norm_hash": f.norm_hash})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
        if objects_over:
            logging.getLogger(__name__).warning("%d objects went over the budgets of their stretches, dropped: %s", objects_over, dict(dropped))

    return objects.select(F.col(id_col).cast("string").alias("object_id"), F.col(content_col).cast("binary").alias("content")).mapInArrow(run, SCHEMA)


@dataclass(frozen=True)
class Chunks:
    """Geometry of chunks: payload size and the overlap each carries from before."""

    size: int = 4 << 20
    overlap: int = 64 << 10


def chunked(objects: DataFrame, chunks: Chunks, *, id_col: str = "object_id", content_col: str = "content") -> DataFrame:
    """(object_id, base_offset, prefix_len, content): payload chunks with carried overlap."""
    size, overlap = chunks.size, chunks.overlap
    data = F.col(content_col).cast("binary")
    starts = objects.select(F.col(id_col).alias("object_id"), data.alias("data"), F.explode(F.expr(f"sequence(0L, greatest(0L, cast(length({content_col}) as bigint) - 1), {size}L)")).alias("at"))
    prefix = F.least(F.col("at"), F.lit(overlap))
    return starts.select("object_id", (F.col("at") - prefix).alias("base_offset"), prefix.alias("prefix_len"), F.substring("data", (F.col("at") - prefix + 1).cast("int"), (prefix + size).cast("int")).alias("content"))
