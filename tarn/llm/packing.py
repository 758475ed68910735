"""Packing by minimum bin slack.

Documents become token sequences, each closed by an end token. Whole windows are
cut off first; the remainders wait in a pool. For each window, dynamic programming
over a bitset of reachable sums (bounded multiplicities in binary parts) finds the
multiset of remaining lengths that comes closest to the capacity, and backtracking
tells how many of each length it takes. Where even the best multiset leaves slack,
a waiting piece is cut to fill it, so only a task's last tokens can't fill a window;
those are cut to lengths that are powers of two, which need no padding.

Each task packs the rows of its own partition: there is no shuffle, and memory is
bounded by ``pool_tokens``. Tasks are pure functions of their partition, so a lost
executor's pieces come out the same again.

Defined results: a null text is an empty one; an empty text is the end token alone;
a null id is kept; repeated rows are packed as rows of their own; an empty table
gives no pieces; any length of text is cut into as many windows as it needs.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tarn.llm._common import small_batches, texts, tidy, worker_cache

SCHEMA = "doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("token_ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

#: White space of the tokenizer's beyond ASCII; it takes a row of any for one space.
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: A chunk that is a word of letters, with marks around it or none.
WORD_BETWEEN_MARKS = r"^(?P<head>[[:punct:]]*)(?P<word>\pL+)(?P<tail>[[:punct:]]*)$"

#: So many words are merged in one call; in longer rows of them each merge takes longer.
WORDS = 100

#: A byte that no UTF-8 text has; it stands for the end of a word.
WORD_END = b"\xff"


def _letter_pieces(model: dict):
    """Byte-pair merging of words of letters by the ranks of the tokenizer's own vocabulary, and which ids end a word.

    Its ids are ordered as its merges are: bytes, bytes that end a word, then merges.
    """
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    suffix = model["end_of_word_suffix"]
    ranks = {}
    for token, rank in model["vocab"].items():
        body = token.removesuffix(suffix)
        if all(c in byte for c in body):
            ranks[bytes(byte[c] for c in body) + WORD_END * (body != token)] = rank
    ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
    ends[[rank for token, rank in ranks.items() if token.endswith(WORD_END)]] = True
    return tiktoken.Encoding("letters", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece, ends


class ChunkTokenizer(dict):
    """Ids of whole texts, as little-endian 32-bit bytes, by way of their distinct chunks.

    The tokenizer never joins characters across white space, so the ids of a text
    are those of its white-space separated chunks, one after another. Within a chunk
    it never joins letters to marks either, so a word between marks is merged by
    itself, and the words of many texts in a few calls. All other chunks, marks, and
    chunks that hold one of the tokenizer's added tokens are left to the tokenizer;
    this is the dictionary of those met so far. ``most`` bounds it, where a chunk
    counts once and again for each 64 characters: half of it is filled, then serves
    as ``older`` while the chunks that are met again move to the next half.
    """

    def __init__(self, file: str, most: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        described = json.loads(self.tokenizer.to_str())
        self.letters, self.ends = _letter_pieces(described["model"])
        self.added = [t["content"] for t in described["added_tokens"]]
        self.half = self.room = most // 2
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if self.room <= 0:
            self.older, self.room = dict(self), self.half
            self.clear()
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.whole(chunk)
        self[chunk] = ids
        self.room -= 1 + len(chunk) // 64
        return ids

    def whole(self, text: str) -> bytes:
        """Ids by the tokenizer itself."""
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def found(self, chunks: pa.Array) -> pa.Array:
        """Ids of each of the chunks, which are distinct."""
        parts = pc.extract_regex(chunks, WORD_BETWEEN_MARKS)
        plain = parts.is_valid()
        for a in self.added:
            plain = pc.and_not(plain, pc.match_substring(chunks, a))
        head, word, tail = parts.flatten()
        plain = np.flatnonzero(pc.and_not(plain, pc.match_substring(head, "'").fill_null(True)))
        words = _lower(word.take(plain))
        if not "".join(words).isalpha():
            letters = np.fromiter(map(str.isalpha, words), bool, len(words))
            plain, words = plain[letters], list(compress(words, letters))
        between = pc.binary_join_element_wise(self._marks(head.take(plain)), self._words(words), self._marks(tail.take(plain)), pa.scalar(b"", pa.large_binary()))
        odd = np.setdiff1d(np.arange(len(chunks)), plain, assume_unique=True)
        others = pa.array([self[c] for c in chunks.take(odd).to_pylist()], pa.large_binary())
        place = np.empty(len(chunks), dtype=np.int64)
        place[np.concatenate([plain, odd])] = np.arange(len(chunks))
        return pa.concat_arrays([between, others]).take(place)

    def _marks(self, marks: pa.Array) -> pa.Array:
        coded = marks.dictionary_encode()
        return pa.array([self[m] if m else b"" for m in coded.dictionary.to_pylist()], pa.large_binary()).take(coded.indices)

    def _words(self, words: list[str]) -> pa.Array:
        """Ids of each of some words of letters by rank merging, many in one call: no token goes on behind the end of a word."""
        distinct = list(dict.fromkeys(words))
        found = [np.empty(0, dtype="<u4")]
        for at in range(0, len(distinct), WORDS):
            row = "\0".join([*distinct[at : at + WORDS], ""]).encode().replace(b"\0", WORD_END)
            found.append(np.array(self.letters(row), dtype="<u4"))
        ids = np.concatenate(found)
        stops = np.concatenate([[0], 4 * (np.flatnonzero(self.ends[ids]) + 1)]).astype(np.int64)
        each = pa.Array.from_buffers(pa.large_binary(), len(distinct), [None, pa.py_buffer(stops), pa.py_buffer(ids)])
        return each.take(pa.array(words, pa.large_string()).dictionary_encode().indices)

    def many(self, texts: pa.Array) -> list[bytes]:
        """Ids of each of the texts."""
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, WIDE_SPACE, " "))
        chunks = lists.flatten().dictionary_encode()
        ids = self.found(chunks.dictionary).take(chunks.indices)
        _, stops, data = ids.buffers()
        at = np.frombuffer(stops, "<i8")[lists.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]

    def ids(self, text: str) -> bytes:
        return self.many(pa.array([text]))[0]


def _lower(words: pa.Array) -> list[str]:
    """Words as the tokenizer's normalizer leaves them, which lower-cases each character by itself."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\0", words.type))[0].as_py()
    return unicodedata.normalize("NFC", joined).replace("\u03a3", "\u03c3").lower().split("\0") if len(words) else []


def _groups(column: pa.Array, most: int = 1_000_000):
    """Slices of about ``most`` bytes of text, as (first, behind the last)."""
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), len(column)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def least_slack(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum <= capacity of a sub-multiset of ``counts``, and how many it takes of each length.

    ``reach`` has bit s set if some sub-multiset sums to s. A length with
    multiplicity m enters as parts of 1, 2, 4, ... and the rest, so every number
    from 0 to m can be made.
    """
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, part = left - take, part * 2
        if reach >> capacity:
            break
    best = total = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] += take
    return best, chosen


class Pool:
    """Pieces that wait, by length; of a length the last to come leaves first."""

    def __init__(self) -> None:
        self.waiting: dict[int, list] = defaultdict(list)
        self.lengths: list[int] = []
        self.tokens = 0

    def add(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        if not self.waiting[length]:
            insort(self.lengths, length)
        self.waiting[length].append(piece)
        self.tokens += length

    def take(self, length: int) -> tuple:
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
            self.lengths.remove(length)
        self.tokens -= length
        return piece

    def window(self, capacity: int) -> list[tuple]:
        """Pieces that fill a window: the longest that waits, and the multiset that leaves least slack beside it."""
        out = [self.take(self.lengths[-1])]
        room = capacity - len(out[0][2]) // 4
        if room and self.tokens:
            counts = {n: len(self.waiting[n]) for n in self.lengths if n <= room}
            best, chosen = least_slack(counts, room)
            out += [self.take(n) for n, many in chosen.items() for _ in range(many)]
            room -= best
        if room and self.lengths and self.lengths[-1] > room:
            doc, start, ids, total = self.take(self.lengths[bisect_left(self.lengths, room + 1)])
            out.append((doc, start, ids[: 4 * room], total))
            self.add((doc, start + room, ids[4 * room :], total))
        return out


def powers(pieces: list[tuple]) -> list[list[tuple]]:
    """Cut the pieces into sequences whose lengths are powers of two."""
    total, out = sum(len(p[2]) // 4 for p in pieces), []
    rest = pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, sequence = 1 << bit, []
            while room:
                doc, start, ids, n = rest.pop()
                if len(ids) > 4 * room:
                    rest.append((doc, start + room, ids[4 * room :], n))
                    ids = ids[: 4 * room]
                sequence.append((doc, start, ids, n))
                room -= len(ids) // 4
            out.append(sequence)
    return out


def sequences(pieces, capacity: int, pool_tokens: int):
    """Sequences (lists of pieces) from a stream of (doc, start, ids, doc_tokens) of at most ``capacity`` tokens each."""
    pool = Pool()
    for piece in pieces:
        if len(piece[2]) == 4 * capacity:
            yield [piece]
            continue
        pool.add(piece)
        while pool.tokens > pool_tokens:
            yield pool.window(capacity)
    while pool.tokens >= capacity:
        yield pool.window(capacity)
    if pool.tokens:
        yield from powers([pool.take(n) for n in pool.lengths[::-1] for _ in range(len(pool.waiting[n]))])


def pack(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, pool_tokens: int = 2_000_000) -> DataFrame:
    """Pieces of all documents with their ids and their place in a sequence."""

    def run(batches):
        tokenizer = _tokenizer(tokenizer_file)
        end = int(end_id).to_bytes(4, "little")

        def pieces():
            for batch in batches:
                docs = batch.column(0).to_pylist()
                for a, b in _groups(batch.column(1)):
                    for doc, ids in zip(docs[a:b], tokenizer.many(batch.column(1).slice(a, b - a)), strict=True):
                        ids += end
                        for at in range(0, len(ids), 4 * capacity):
                            yield doc, at // 4, ids[at : at + 4 * capacity], len(ids) // 4

        first = TaskContext.get().partitionId() << 40
        rows, size = [], 0
        for k, sequence in enumerate(sequences(pieces(), capacity, pool_tokens)):
            offset = 0
            for doc, start, ids, total in sequence:
                rows.append((doc, start, len(ids) // 4, ids, total, first + k, offset))
                offset += len(ids) // 4
                size += len(ids)
            if size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
        tidy()

    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def _tokenizer(file: str) -> ChunkTokenizer:
    """One for each Python worker; its cache serves later tasks too."""
    return worker_cache(("tokenizer", file), lambda: ChunkTokenizer(file))
