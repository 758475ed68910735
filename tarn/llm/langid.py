"""Language of code-switched text by a linear-chain conditional random field over words.

Each word has features: its prefixes and suffixes, character bigrams and trigrams, and
whether it is in a lexicon of short frequent words, with the language it is most
frequent in. Weights of features and of transitions between the languages of
neighbouring words are trained together by the gradient of the conditional
likelihood (forward-backward). Labels are given by document, so training sequences
are made code-switched by joining stretches of documents of different languages:
transitions are learned as well as staying.

Prediction labels every word of a whole text with its marginal distribution; a
document's distribution is the mean over its words, weighted by letters. Stretches of
more than 64 characters without white space are cut at what isn't a letter, and every
64 characters; all pieces count as words. Chains of any length
are computed in blocks: products of transfer matrices give each block's entry, then
all blocks go in step, so a batch of documents is a few array operations a step.

``sample_documents`` and ``sample_words`` bound the training sample: of each language the
same number of documents, one at least, by the smallest hash of id, from all over the
table, and from each a stretch of words that starts at a hashed place, each word cut to
64 characters. The languages are those of all labelled rows.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows
are predicted one by one, repeated ones too; without labelled rows every prediction
is ``und``; an empty table gives no rows; a null id counts as the empty string for
the fold; of languages with equal probabilities the first by name is told; columns other
than id, text and language clash with nothing: ``keep`` carries them in a struct.
"""

from __future__ import annotations

from itertools import groupby
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tarn.llm._common import small_batches, tidy, worker_cache

UNKNOWN = "und"
DIMENSIONS = 1 << 16
BLOCK = 64


def fold(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def training_rows(docs: DataFrame, sample_documents: int, sample_words: int) -> list[tuple[str, str]]:
    """(stretch of text, lang) of a bounded sample of labelled rows outside the held-out fold."""
    order = F.xxhash64(F.lit("train"), "doc_id")
    labelled = docs.where(docs.lang.isNotNull() & docs.text.isNotNull() & (fold(docs.doc_id) != 2)).withColumn("o", order)
    languages = labelled.select("lang").distinct().count()
    if not languages:
        return []
    each = max(1, sample_documents // languages)
    # The hashes alone are ranked; then the texts of the chosen rows are cut before they are moved.
    last = _first(labelled.select("lang", "o"), each, "o").groupBy("lang").agg(F.max("o").alias("last"))
    chosen = labelled.join(F.broadcast(last), "lang").where("o <= last")  # a row for each language
    words = chosen.select("lang", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"), "o", "doc_id")
    start = F.pmod(F.col("o"), F.greatest(F.lit(1), F.size("w") - sample_words)) + 1
    rows = words.select("lang", F.array_join(F.transform(F.slice("w", start.cast("int"), sample_words), lambda w: F.left(w, F.lit(LONGEST))), " ").alias("t"), "o", "doc_id")
    # Rows that share an id may be any number; as many as the sample stay.
    return sorted((r.t, r.lang) for r in _first(rows, each, "o", "doc_id", "t").select("t", "lang").collect())


#: Shares that partitions are dealt to, so no task ranks the candidates of all partitions.
SHARES = 32


def _first(rows: DataFrame, each: int, *order: str) -> DataFrame:
    """The first ``each`` rows of each language: of a partition, of a share of the partitions, then of at most ``SHARES`` times ``each``."""
    rows = rows.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    for by in (("lang", "share"), ("lang",)):
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("k") <= each)
    return rows


#: Characters of a word; longer ones are cut into pieces, all of which count.
LONGEST = 64

#: Marks that words are stripped of.
MARKS = ".,;:!?\"'()[]#$%&*"


def words_of(text: str) -> list[str]:
    """Stretches without white space that hold a letter, in lower case and without marks around them; long ones in pieces."""
    words = [w for x in text.lower().split() if (w := x.strip(MARKS)).isalpha() or any(map(str.isalpha, w))]
    if max(map(len, words), default=0) > LONGEST:
        return [p for w in words for p in (pieces_of(w) if len(w) > LONGEST else (w,))]
    return words


def pieces_of(run: str):
    """All runs of letters, with the accents and vowel signs on them, in pieces of at most ``LONGEST`` characters."""
    for letters, own in groupby(run, lambda c: c.isalpha() or category(c)[0] == "M"):
        if letters:
            part = "".join(own)
            yield from (p for k in range(0, len(part), LONGEST) if any(map(str.isalpha, p := part[k : k + LONGEST])))


class Features:
    """Hashed features of a word, with the learned lexicon."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.known: dict[str, int] = {}

    def _hash(self, name: str) -> int:
        import zlib

        if len(self.known) > 200_000:
            self.known.clear()
        h = self.known[name] = zlib.crc32(name.encode()) % DIMENSIONS
        return h

    def __call__(self, word: str) -> list[int]:
        core = "".join(filter(str.isalpha, word))
        bound = f"^{core}$"
        names = [f"p{bound[:n]}" for n in (2, 3, 4)] + [f"s{bound[-n:]}" for n in (2, 3, 4)]
        names += [bound[k : k + 2] for k in range(len(bound) - 1)] + [bound[k : k + 3] for k in range(len(bound) - 2)]
        names.append(f"lexicon {self.lexicon[core]}" if core in self.lexicon else "no lexicon")
        known = self.known
        return [known[x] if x in known else self._hash(x) for x in set(names)]


class Model:
    """Weights of features (dimensions x languages), transitions and beginnings."""

    def __init__(self, languages: list[str], lexicon: dict[str, int]):
        import numpy as np

        self.languages = languages
        self.features = Features(lexicon)
        self.weights = np.zeros((DIMENSIONS, len(languages)))
        self.moves = np.zeros((len(languages), len(languages)))
        self.begin = np.zeros(len(languages))

    def emission(self, word: str):
        return self.weights[self.features(word)].sum(0)


def marginals(emissions, firsts, moves, begin):
    """Marginals of every word of many chains laid end to end; ``firsts`` marks where chains begin.

    A chain's first word takes its state from ``begin`` whatever came before, so the
    chains are one product of transfer matrices. Blocks are multiplied out in step;
    a short loop over blocks carries the state; then every block runs in step again.
    """
    import numpy as np

    n, s = emissions.shape
    e = np.exp(emissions - emissions.max(1, keepdims=True))
    stay, start = np.exp(moves - moves.max()), np.exp(begin - begin.max())
    blocks = -(-n // BLOCK)
    e = np.concatenate([e, np.ones((blocks * BLOCK - n, s))]).reshape(blocks, BLOCK, s)
    # What fills the last block is a chain of its own, so it says nothing about the words before.
    first = np.concatenate([firsts, np.ones(blocks * BLOCK - n, bool)]).reshape(blocks, BLOCK)

    def step(state, k):
        """state (blocks x rows x s) times the matrix of word k."""
        moved = np.where(first[:, k, None, None], state.sum(2, keepdims=True) * start, state @ stay)
        moved = moved * e[:, k, None, :]
        return moved / moved.max((1, 2), keepdims=True)

    def back(state, k):
        """the matrix of word k times state (blocks x s x columns)."""
        weighted = e[:, k, :, None] * state
        moved = np.where(first[:, k, None, None], np.broadcast_to((start[:, None] * weighted).sum(1, keepdims=True), weighted.shape), stay @ weighted)
        return moved / moved.max((1, 2), keepdims=True)

    product = np.broadcast_to(np.eye(s), (blocks, s, s))
    for k in range(BLOCK):
        product = step(product, k)
    ahead, behind = np.empty((blocks, 1, s)), np.empty((blocks, s, 1))
    state = np.full((1, s), 1.0 / s)
    for b in range(blocks):
        ahead[b] = state
        state = state @ product[b]
        state = state / state.sum()
    state = np.ones((s, 1))
    for b in reversed(range(blocks)):
        behind[b] = state
        state = product[b] @ state
        state = state / state.sum()
    alpha, beta = np.empty((blocks, BLOCK, s)), np.empty((blocks, BLOCK, s))
    for k in range(BLOCK):
        ahead = step(ahead, k)
        alpha[:, k] = ahead[:, 0]
    for k in reversed(range(BLOCK)):
        beta[:, k] = behind[:, :, 0]
        behind = back(behind, k)
    out = alpha * beta
    return (out / out.sum(2, keepdims=True)).reshape(-1, s)[:n], alpha.reshape(-1, s)[:n], beta.reshape(-1, s)[:n]


def train(rows: list[tuple[str, str]], *, rounds: int = 40, rate: float = 0.15, decay: float = 1e-4, stretch: int = 12, seed: int = 7) -> Model | None:
    """Fit the field to (text, language) rows by Adam on the whole sample."""
    import numpy as np

    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    pieces, counts = [], {}
    for text, lang in rows:
        w, y = words_of(text), languages.index(lang)
        pieces += [(w[k : k + stretch], y) for k in range(0, len(w), stretch)]
        for x in w:
            core = "".join(filter(str.isalpha, x))
            if len(core) <= 4:
                counts.setdefault(core, np.zeros(len(languages)))[y] += 1
    frequent = sorted(counts, key=lambda c: (-counts[c].sum(), c))[: 100 * len(languages)]
    model = Model(languages, {c: int(counts[c].argmax()) for c in frequent if c})
    pieces = [pieces[k] for k in rng.permutation(len(pieces))]
    words, labels, firsts = [], [], []
    for k, (w, y) in enumerate(pieces):
        words += w
        labels += [y] * len(w)
        firsts += [j == 0 and k % 5 == 0 for j in range(len(w))]
    if not words:
        return None
    firsts[0] = True
    labels, firsts = np.array(labels), np.array(firsts)
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(words))}
    which = np.array([vocabulary[w] for w in words])
    own = [model.features(w) for w in vocabulary]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    column = np.concatenate([np.array(x) for x in own])
    s, n = len(languages), len(words)
    gold = np.zeros((n, s))
    gold[np.arange(n), labels] = 1
    inner = np.flatnonzero(~firsts[1:]) + 1
    memory: dict[str, tuple] = {}

    def adam(name, value, slope, t):
        m, v = memory.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        memory[name] = (m, v)
        return value + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)

    for t in range(1, rounds + 1):
        table = np.stack([np.bincount(row, model.weights[column, j], len(own)) for j in range(s)], 1)
        emissions = table[which]
        p, alpha, beta = marginals(emissions, firsts, model.moves, model.begin)
        by_word = np.stack([np.bincount(which, (gold - p)[:, j], len(own)) for j in range(s)], 1)
        slope = np.stack([np.bincount(column, by_word[row, j], DIMENSIONS) for j in range(s)], 1)
        e = np.exp(emissions - emissions.max(1, keepdims=True))
        # Expected moves, in steps of bounded size.
        moved, turn, step = np.zeros((s, s)), np.exp(model.moves - model.moves.max()), max(1, (1 << 22) // (s * s))
        for k in range(0, len(inner), step):
            at = inner[k : k + step]
            pair = alpha[at - 1][:, :, None] * turn * (e[at] * beta[at])[:, None, :]
            moved += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        told = np.zeros((s, s))
        np.add.at(told, (labels[inner - 1], labels[inner]), 1)
        model.weights = adam("weights", model.weights, slope / n - decay * model.weights, t)
        model.moves = adam("moves", model.moves, (told - moved) / n - decay * model.moves, t)
        model.begin = adam("begin", model.begin, (gold - p)[firsts].sum(0) / n - decay * model.begin, t)
    return model


class Emissions(dict):
    """Rows of a growing table by word; beyond ``most``, ``shrink`` keeps those of the last batch."""

    def __init__(self, model: Model, most: int = 400_000):
        import numpy as np

        self.model, self.most = model, most
        self.table = np.zeros((1024, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        import numpy as np

        k = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = self.model.emission(word)
        self[word] = k
        return k

    def shrink(self, used) -> None:
        """Keep the words whose rows are in ``used``."""
        import numpy as np

        kept, words = np.unique(used), list(self)  # a word's row is its place
        self.table[: len(kept)] = self.table[kept]
        self.clear()
        self.update((words[k], n) for n, k in enumerate(kept.tolist()))


def predict(docs: DataFrame, model: Model | None, key: str = "", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row by its text alone, and the ``carried`` columns, ``text`` last."""
    docs = docs.select("doc_id", "text", (fold(docs.doc_id) == 2).alias("held_out"), *[c for c in carried if c != "text"])
    if model is None:
        return docs.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *carried)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "lang_pred", "score", *carried]
    schema = StructType([*docs.select("doc_id", "held_out").schema, StructField("lang_pred", StringType()), StructField("score", DoubleType()), *docs.select(*carried).schema])

    def run(batches):
        import numpy as np

        model = shared.value
        known = worker_cache(("emissions", key), lambda: Emissions(model))
        which = np.zeros(0, np.int64)
        for batch in _small(batches):
            if len(known) > known.most:
                known.shrink(which)
            found, sizes, spread = [], [], []
            for text in batch.column(1):
                w = words_of(text.as_py()) if text.is_valid else []
                found += map(known.__getitem__, w)
                spread += map(len, w)
                sizes.append(len(w))
            sizes, which = np.array(sizes), np.array(found, np.int64)
            ends = np.cumsum(sizes)
            mean = np.zeros((len(sizes), len(model.languages)))
            if len(which):
                firsts = np.zeros(len(which), bool)
                firsts[(ends - sizes)[sizes > 0]] = True
                p, _, _ = marginals(known.table[which].astype(float), firsts, model.moves, model.begin)
                letters = np.array(spread, float)
                sums = np.add.reduceat(p * letters[:, None], (ends - sizes)[sizes > 0])
                mean[sizes > 0] = sums / sums.sum(1, keepdims=True)
            best = mean.argmax(1)
            lang = [model.languages[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(np.minimum(mean.max(1), 1.0)), *batch.columns[3:], *([batch.column(1)] if "text" in carried else [])], names)
        tidy()

    return docs.mapInArrow(run, schema)


def _small(batches, most: int = 1 << 20):
    """Batches of about ``most`` bytes of text."""
    for batch in batches:
        at, size = 0, 0
        lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)]
        for k, n in enumerate(lengths):
            size += n
            if size > most:
                yield batch.slice(at, k + 1 - at)
                at, size = k + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_documents: int = 1500, sample_words: int = 60, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``, learned from its own labelled rows; the row's columns in ``keep`` come along as the struct ``row``, the text itself as ``text``."""
    import uuid

    others = [docs[c] for c in keep if c != text_col]
    row = [F.struct(*others).alias("row")] if others else []
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), *row)
    model = train(training_rows(docs, sample_documents, sample_words))
    return predict(docs, model, uuid.uuid4().hex, (*(["row"] if others else []), *(["text"] if text_col in keep else [])))
