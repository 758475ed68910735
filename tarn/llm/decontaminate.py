"""Benchmark decontamination: a BM25 index of the test items that every training passage queries by block-max WAND.

The index goes the other way round from a search engine's: the test items are the
documents, and each passage of the training texts is a query. An item's BM25 score is
a sum over the words it shares with the passage. An item's own threshold is what a
passage must reach if it holds ``overlap`` of the item's shingles of ``words`` words:
the item's score for itself less its heaviest words, as many as may be missing (each
missing word breaks a shingle at least). So no passage that would pass the check is
lost in retrieval.

Passages are windows of three times the longest item or ``GAP``, one beginning each
such length, so every occurrence lies whole in one, also with as many words between
question and answer. The largest weight of each word in each
block of items bounds what a block's items can score; blocks that can't reach the
threshold are skipped, and in the others WAND walks the postings of the passage's
words and skips the items that can't. What is retrieved is verified: of the question's shingles and of the answer's
(the last sentence, where an item has more) ``overlap`` must occur in the passage.
The shingles that join the two are the answer's; where both stand whole in the passage
with other words between them, such as a label or choices, these don't count, unless
both are shorter than ``words``.

The items' index is sent to all tasks in shards of at most ``shard_items`` different
texts and about ``shard_bytes`` bytes; a larger benchmark takes more passes. An item of
more than ``most_words`` words is cut into parts, and found if the parts that are found
make up ``overlap`` of its words.

Defined results: a question, answer or item of fewer than ``words`` words is one
shingle, found wherever its words stand in a row; null and empty texts match nothing;
items without words are ignored; items without an id are found as all others, with a null
id; repeated items and rows match one by one; other columns are left out, whatever their
names; empty tables give no rows; texts are read whole, a stretch of windows at a time.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._common import small_batches, texts, tidy, worker_cache

K1, B = 1.2, 0.75
#: Items in a block that has its own bound.
BLOCK = 8
#: Bounds of blocks that are looked at together, a window's at least.
CELLS = 1 << 18
#: Words between question and answer that never part them, where no item is longer.
GAP = 64
FOUND = "doc_id long, digest string, score double, question_overlap double, answer_overlap double"
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


#: Marks that words are stripped of, so a leak with other case or punctuation is the same.
MARKS = ".,;:!?#$%&*()[]\"'"


def tokens(text: bytes) -> list[str]:
    """Lower-case words between white space, without the marks around them."""
    return [w for x in text.decode("utf-8", "replace").lower().split() if (w := x.strip(MARKS))]


def split_item(text: str) -> tuple[list[str], int]:
    """An item's words, and how many of them are its question: all but the last line, or else the last sentence."""
    lines = [x for x in re.split(r"\n+", text) if x.strip()]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.?!])\s+", text) if x.strip()]
    question = tokens(" ".join(lines[:-1] if len(lines) > 1 else lines).encode())
    whole = tokens(text.encode())
    return whole, len(question)


def _share(shingles: set[tuple], window: list[str], held: dict[int, set]) -> float:
    """How much of a set of shingles of one length a window holds; short ones are compared with n-grams of their own length."""
    if not shingles:
        return 1.0
    n = len(next(iter(shingles)))
    if n not in held:
        held[n] = {tuple(window[k : k + n]) for k in range(len(window) - n + 1)}
    return len(shingles & held[n]) / len(shingles)


class Index:
    """Postings of the items of a shard, with their BM25 weights and the largest weight of each block."""

    def __init__(self, items: list[tuple[str, str]], words: int, overlap: float, longest: int):
        self.ids, self.words, self.overlap = [], words, overlap
        parts = []
        for item, text in sorted(items, key=lambda x: (x[0], x[1])):
            w, q = split_item(text)
            for at in range(0, len(w), longest):
                parts.append((item, w[at : at + longest], max(0, min(q - at, longest))))
        self.ids = [p[0] for p in parts]
        self.sizes = [len(p[1]) for p in parts]
        self.whole: dict = {}
        for item, w, _ in parts:
            self.whole[item] = self.whole.get(item, 0) + len(w)
        self.length = max([GAP, *(len(p[1]) for p in parts)])
        self.questions = [self._shingles(w[:q]) for _, w, q in parts]
        # The shingles that join question and answer belong to the answer.
        self.answers = [self._shingles(w) - self.questions[k] for k, (_, w, _) in enumerate(parts)]
        # Its own shingles, for answers that stand apart from the question; two short parts could do so anywhere.
        self.apart = [self._shingles(w[q:]) if max(q, len(w) - q) >= words else set() for _, w, q in parts]
        frequency: dict[str, int] = {}
        for _, w, _ in parts:
            for x in set(w):
                frequency[x] = frequency.get(x, 0) + 1
        mean = sum(len(w) for _, w, _ in parts) / max(1, len(parts))
        self.terms: dict[str, int] = {}
        self.postings: list[list[tuple[int, float]]] = []
        self.thresholds = []
        for k, (_, w, _) in enumerate(parts):
            weight = {}
            for x in set(w):
                tf = w.count(x)
                weight[x] = math.log(1 + (len(parts) - frequency[x] + 0.5) / (frequency[x] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            missing = int((1 - overlap) * len(self.questions[k]) + 1e-9) + int((1 - overlap) * len(self.answers[k]) + 1e-9)
            # Weights are kept as shares of the item's threshold, so one bound serves items of all lengths.
            self.thresholds.append(max(sum(weight.values()) - sum(sorted(weight.values(), reverse=True)[:missing]), 1e-3))
            for x in sorted(weight):
                if x not in self.terms:
                    self.terms[x] = len(self.terms) + 1
                    self.postings.append([])
                self.postings[self.terms[x] - 1].append((k, weight[x] / self.thresholds[k]))
        self.least = 1 - 1e-9
        # Block maxima of all terms in one row, by term: which block, and the largest weight in it.
        slices: list[dict[int, list]] = []
        for p in self.postings:
            slices.append({})
            for x in p:
                slices[-1].setdefault(x[0] // BLOCK, []).append(x)
        self.slices = [{}, *({b: (p, max(x[1] for x in p)) for b, p in x.items()} for x in slices)]
        self.count = np.array([len(x) for x in self.slices], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]])
        self.block = np.array([b for x in self.slices for b in x], np.int64)
        self.bound = np.array([most for x in self.slices for _, most in x.values()])
        self.blocks = -(-len(parts) // BLOCK)
        # The terms that each block holds.
        self.held: list[set[int]] = [set() for _ in range(self.blocks)]
        for t, x in enumerate(self.slices):
            for b in x:
                self.held[b].add(t)

    def _shingles(self, w: list[str]) -> set[tuple]:
        n = self.words
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    def live(self, terms):
        """(window, block) pairs whose bound reaches the threshold; windows are three neighbouring segments of ``length`` words.

        A block's bound for a window is the sum of its maxima over the window's distinct terms.
        """
        windows, step = max(3, -(-len(terms) // self.length)) - 2, max(1, CELLS // self.blocks)
        for start in range(0, windows, step):
            many = min(step, windows - start)
            part = terms[start * self.length : (start + many + 2) * self.length]
            for window, block in self._live(part, many):
                yield window + start, block

    def _live(self, terms, windows: int) -> list[list[int]]:
        at = np.flatnonzero(terms)
        keys = np.concatenate([(at // self.length - k) * len(self.slices) + terms[at] for k in range(3)])
        own = np.unique(keys[(keys >= 0) & (keys < windows * len(self.slices))])
        window, term = own // len(self.slices), own % len(self.slices)
        many = self.count[term]
        total = int(many.sum())
        entry = np.repeat(self.first[term] - np.cumsum(many) + many, many) + np.arange(total)
        bound = np.bincount(np.repeat(window, many) * self.blocks + self.block[entry], self.bound[entry], windows * self.blocks)
        return np.argwhere(bound.reshape(windows, self.blocks) >= self.least).tolist()

    def retrieve(self, terms: set[int], block: int) -> list[tuple[int, float]]:
        """(part, score) of the parts of a block whose score reaches their threshold, for distinct terms, by WAND."""
        lists = [[p, 0, most] for t in self.held[block] & terms for p, most in (self.slices[t][block],)]
        out = []
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            bound, part = 0.0, -1
            for p, at, most in lists:
                bound += most
                if bound >= self.least:
                    part = p[at][0]  # the pivot: no smaller part can reach the threshold
                    break
            if part < 0:
                break
            if lists[0][0][lists[0][1]][0] == part:
                score = sum(p[at][1] for p, at, _ in lists if p[at][0] == part)
                if score >= self.least:
                    out.append((part, score * self.thresholds[part]))
                part += 1
            for x in lists:
                while x[1] < len(x[0]) and x[0][x[1]][0] < part:
                    x[1] += 1
            lists = [x for x in lists if x[1] < len(x[0])]
        return out

    def check(self, part: int, window: list[str], held: dict[int, set]) -> tuple[float, float] | None:
        """The shares of question and answer in a window; ``held`` keeps its n-grams by length."""
        q, a = self.questions[part], self.answers[part]
        shares = tuple(_share(x, window, held) for x in (q, a))
        if min(shares) >= self.overlap - 1e-12 and (q or a):
            return shares
        if q and self.apart[part] and shares[0] == 1.0 == _share(self.apart[part], window, held):
            return 1.0, 1.0
        return None

    def parts(self, text: bytes) -> dict[int, tuple]:
        """Each part that a text contains: (score, question share, answer share) of its best passage."""
        words = tokens(text)
        get = self.terms.get
        terms = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        best: dict[int, tuple] = {}
        last, own, passage, held = -1, set(), [], {}
        for window, block in self.live(terms):
            if window != last:
                at = window * self.length
                last, own, passage, held = window, set(terms[at : at + 3 * self.length].tolist()), words[at : at + 3 * self.length], {}
            for part, score in self.retrieve(own, block):
                if shares := self.check(part, passage, held):
                    best[part] = max(best.get(part, ()), (score, *shares))
        return best

    def matches(self, text: bytes) -> dict[str, tuple]:
        """Each item that a text contains: (score, question share, answer share) of its best passage."""
        out: dict[str, tuple] = {}
        held: dict[str, int] = {}
        for part, told in self.parts(text).items():
            item = self.ids[part]
            out[item] = max(out.get(item, ()), told)
            held[item] = held.get(item, 0) + self.sizes[part]
        return {item: told for item, told in out.items() if held[item] >= self.overlap * self.whole[item] - 1e-9}


def _indexes(items: DataFrame, item_text_col: str, words: int, overlap: float, shard_items: int, shard_bytes: int, most_words: int):
    """A broadcast index for each shard of the different texts of ``items``, by the SHA-256 of the text."""
    spark = items.sparkSession
    small_batches(spark)
    tests = _with_words(items.select(items[item_text_col].cast("string").alias("text"))).distinct().select("text", F.sha2("text", 256).alias("digest"))
    size = tests.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(1, -(-size.n // max(1, shard_items // 2)), -(-(size.bytes or 0) // max(1, shard_bytes // 2)))
    for shard in range(shards):
        own, last = tests.where(F.pmod(F.xxhash64("digest"), F.lit(shards)) == shard), ""
        while rows := own.where(F.col("digest") > last).orderBy("digest").limit(shard_items).collect():
            last = rows[-1].digest
            yield spark.sparkContext.broadcast(Index([(r.digest, r.text) for r in rows], words, overlap, most_words))
            if len(rows) < shard_items:
                break


def _with_words(items: DataFrame) -> DataFrame:
    return items.where("text rlike '[^ \\t-\\r]'")


def matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", words: int = 5, overlap: float = 0.7, shard_items: int = 20_000, shard_bytes: int = 16 << 20, most_words: int = 512) -> DataFrame:
    """A row for each row of ``docs`` and each row of ``items`` it contains."""
    docs = texts(docs, id_col, text_col)
    found = None
    for shared in _indexes(items, item_text_col, words, overlap, shard_items, shard_bytes, most_words):
        part = docs.mapInArrow(_search(shared), FOUND)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    named = items.select(items[item_id_col].cast("long").alias("item_id"), F.sha2(items[item_text_col].cast("string"), 256).alias("digest"))
    return found.join(named, "digest").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def without(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_text_col: str = "text", words: int = 5, overlap: float = 0.7, shard_items: int = 20_000, shard_bytes: int = 16 << 20, most_words: int = 512) -> DataFrame:
    """The rows of ``docs`` that contain none of ``items``, with all their columns, by the row's own text."""
    at = docs.columns.index(text_col)
    for shared in _indexes(items, item_text_col, words, overlap, shard_items, shard_bytes, most_words):
        docs = docs.mapInArrow(_filter(shared, at), docs.schema)
    return docs


def _filter(shared, at: int):
    def run(batches):
        index = worker_cache("index", lambda: None) or shared.value  # other operators' caches go
        for batch in batches:
            yield batch.filter(pa.array([not (t.is_valid and index.matches(t.as_buffer().to_pybytes())) for t in batch.column(at)], pa.bool_()))
        tidy()

    return run


def _search(shared):
    def run(batches):
        index = worker_cache("index", lambda: None) or shared.value  # other operators' caches go
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc, item, *told) for item, told in sorted(index.matches(text.as_buffer().to_pybytes()).items())]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *map(pa.array, columns[1:])], ["doc_id", "digest", "score", "question_overlap", "answer_overlap"])
        tidy()

    return run
