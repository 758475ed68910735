"""Near-duplicate documents from bottom-k sketches of one hash function.

A document's set is its distinct word shingles, each hashed to 64 bits; its sketch is
the k smallest hashes. The steps:

1. Documents with equal sets are one class, named by its smallest id.
2. Inverted lists of the retained hashes give candidates. A class keeps only its
   rarest hashes for this (see ``_prefix``): two classes as similar as the threshold
   share at least t of k hashes, so of any order of the hashes the first k - t + 1
   have one in common. Hashes of passages that many documents share come last in
   that order and generate nothing unless they fill most of a document.
3. Each list links its members to its smallest member only; the pairs are filtered by
   the similarity that the sketch of the union estimates and then verified on the
   full sets, read from the texts again.
4. What these links left in different components, though in one list, is looked at
   again. Lists of at most ``FEW`` members link each member to those of the other
   components, at most ``FEW`` / 2 pairs for a posting. The members of longer lists are
   compared by prefix and position filters on the full sets (``_across``), which are
   exact. The pairs of both go through the same filter and check. So a group of n near
   copies takes about n pairs, and no link between components is lost.
5. Connected components of the verified links.

t is where fewer than one pair in a million at exactly the threshold has less
overlap (hypergeometric in the size of the set); for sets of at most 4 k / 5
shingles both sketches are whole, and the bound is exact.

Defined results: null and empty texts and texts without words have no shingles and
are linked with nothing; a text with fewer words than a shingle is one shingle;
rows that share a doc_id are one document; a row with a null id joins the component of
the documents it is equal to, and has a null component and is not kept where there are
none with an id; columns other than id and text are left out, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._common import drop, materialise, only, small_batches, texts, tidy, worker_cache
from tarn.llm.graph import components


#: Members of a list whose components are compared member by member.
FEW = 24


class WordHashes(dict):
    """64-bit hashes of words; ``most`` bounds the cache."""

    def __init__(self, most: int = 300_000):
        import xxhash

        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.hash(word)
        return h


def shingles(text: bytes, words: int):
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    import numpy as np

    found = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(worker_cache("word hashes", WordHashes).__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for k in range(min(words, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def least_overlap(k: int, similarity: float, n: int | None = None, miss: float = 1e-6) -> int:
    """The largest t with P(fewer than t of a union's k smallest hashes are common) <= miss, for a pair at the threshold.

    Of a set of n the union has at most n / similarity hashes, and drawing k of them is
    hypergeometric; without n the bound is the binomial of an endless union.
    """
    union = None if n is None else max(k, math.ceil(n / similarity))
    common = None if union is None else math.ceil(union * similarity - 1e-9)
    below, t = 0.0, 0
    while t < k:
        if union is None:
            below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        elif k - t <= union - common:
            below += math.comb(common, t) * math.comb(union - common, k - t) / math.comb(union, k)
        if below > miss:
            break
        t += 1
    return t


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, n_shingles, fingerprint of the set, the k smallest hashes in order as longs)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        import numpy as np
        import xxhash

        for batch in batches:
            n, keys, low = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_buffer().to_pybytes(), words)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                low.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(low, pa.list_(pa.int64()))], schema=schema)
        tidy()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def _prefix(size: Column, k: int, similarity: float) -> Column:
    """How many of a sketch's hashes, rarest first, must be looked at."""
    first = int(similarity * k)
    steps = range(first + 1, 20 * k)
    by_size = F.lit([least_overlap(k, similarity, n) for n in steps])
    need = F.when(size <= first, F.ceil(size * F.lit(similarity))).when(size < 20 * k, F.get(by_size, (size - first - 1).cast("int"))).otherwise(F.lit(least_overlap(k, similarity)))
    # A union smaller than a sketch is whole, and four fifths of it are common.
    return (F.least(size, F.lit(k)) - F.least(need, F.ceil(size * F.lit(similarity))) + 1).cast("int")


def _sized(x: str, y: str, similarity: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(similarity)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, k: int, similarity: float, slack: float) -> DataFrame:
    """Those pairs of class ids whose full sets are similar enough."""
    left = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    near = pairs.join(left, "a").join(right, "b").where(_sized("n_a", "n_b", similarity))
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    near = near.where(F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union)) >= F.size(union) * F.lit(similarity - slack)).select("a", "b").distinct()
    near = materialise(near, "near")
    used = materialise(near.select(F.col("a").alias("doc_id")).unionAll(near.select(F.col("b").alias("doc_id"))).distinct(), "used")
    whole = materialise(only(docs, used, "doc_id"), "texts")
    both = near.join(whole.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(whole.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    percent = round(similarity * 100)

    def run(batches):
        import numpy as np

        last: dict[bytes, object] = {}

        def of(text: bytes):
            if text not in last:
                if len(last) > 8:
                    last.clear()
                last[text] = shingles(text, words)
            return last[text]

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = of(x.as_buffer().to_pybytes()), of(y.as_buffer().to_pybytes())
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    links = materialise(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct(), "links")
    drop(near, used, whole)
    return links


def _across(left: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes in different components that may be similar enough, by exact prefix and position filters on full sets.

    ``left`` has (rep, n_shingles, c). Only shingles that several components hold can be
    common to a pair; each set's are put in one order, rarest first. If a pair's first common shingle stands at place i of one set and j of the
    other, at most min(n - i, m - j) are common, which must reach
    similarity / (1 + similarity) of n + m. So a set only enters with the places that
    leave room for a partner, and a copy whose own changes already fill that room
    meets nobody, however large its group. In each list the component that has most
    of it is joined with the others only.
    """
    share = similarity / (1 + similarity)
    schema = pa.schema([("rep", pa.int64()), ("c", pa.int64()), ("h", pa.int64())])

    def run(batches):
        import numpy as np

        for batch in batches:
            for rep, c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingles(text.as_buffer().to_pybytes(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), rep)), pa.array(np.full(len(s), c)), pa.array(s)], schema=schema)
        tidy()

    named = left.select(F.col("rep").alias("doc_id"), "c")
    whole = only(docs, named, "doc_id", "inner").select("doc_id", "c", "text")
    sets = materialise(whole.mapInArrow(run, "rep long, c long, h long"), "sets")
    common = materialise(sets.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h", "df"), "common")
    found = sets.select("rep", "h").join(common, "h").groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("found")).join(left, "rep")
    alone = F.col("n_shingles") - F.size("found")
    room = F.floor(F.col("n_shingles") * (1 - similarity) + 1e-6) + 1 - alone
    entries = found.where(room > 0).select("rep", "c", F.col("n_shingles").alias("n"), alone.alias("alone"), F.posexplode(F.slice("found", F.lit(1), room.cast("int"))).alias("k", "x"))
    entries = materialise(entries.select("rep", "c", "n", (F.col("alone") + F.col("k")).alias("i"), F.col("x.h").alias("h")), "entries")
    drop(sets, common)
    main = entries.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("many")).where("many > 1").select("h", "main")
    entries = materialise(entries.join(materialise(main, "main"), "h").withColumn("minor", F.col("c") != F.col("main")).drop("main"), "entries")
    small = F.col("n") - F.col("i") >= F.col("n") * (2 * share) - 1e-6
    out = None
    for one, two in ((entries.where(small & F.col("minor")), entries), (entries.where(small & ~F.col("minor")), entries.where("minor"))):
        x, y = one.alias("x"), two.alias("y")
        most = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
        fits = (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.n") <= F.col("y.n")) & (most >= (F.col("x.n") + F.col("y.n")) * share - 1e-6)
        pairs = x.join(y, fits).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        out = pairs if out is None else out.unionAll(pairs)
    return out.distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, k: int = 64, slack: float = 0.3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    ``slack`` is how far the estimate of the sketches may fall short of the
    similarity before a pair is dropped; at k = 64 it is six standard deviations.
    """
    docs = texts(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    rows = materialise(sketches(docs, words, k), "sketches")
    classes = materialise(rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    # One row of each class: the same id with the same set, however often it is repeated.
    reps = materialise(rows.join(classes, (rows.set_key == classes.set_key) & (rows.doc_id == classes.rep)).select("rep", "n_shingles", "sketch").distinct(), "reps")

    facts = materialise(rows.select("doc_id", "n_shingles", "set_key"), "facts")
    drop(rows)

    postings = reps.select("rep", F.explode("sketch").alias("h"))
    # Aggregates are written out before they are joined: with a shuffle on either side Spark can split a frequent key.
    lists = materialise(postings.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "lists")
    shared = postings.join(lists, "h").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("found")).join(reps.select("rep", "n_shingles"), "rep")
    alone = F.least("n_shingles", F.lit(k)) - F.size("found")
    room = (_prefix(F.col("n_shingles"), k, similarity) - alone).cast("int")
    listed = materialise(shared.where(room > 0).select("rep", "n_shingles", F.explode(F.slice("found", F.lit(1), room)).alias("x")).select("rep", "n_shingles", F.col("x.h").alias("h")), "listed")

    pivots = materialise(listed.groupBy("h").agg(F.min(F.struct("rep", "n_shingles")).alias("p"), F.count(F.lit(1)).alias("df")).where("df > 1").select("h", F.col("p.rep").alias("a"), F.col("p.n_shingles").alias("n_a")), "pivots")
    stars = materialise(listed.join(pivots, "h").where((F.col("rep") > F.col("a")) & _sized("n_a", "n_shingles", similarity)).select("a", F.col("rep").alias("b")).distinct(), "stars")
    links = _verified(stars, reps, docs, words, k, similarity, slack)

    first = materialise(components(links), "components")
    own = listed.join(first, listed.rep == first.id, "left").select("h", "rep", "n_shingles", F.coalesce("component", "rep").alias("c"))
    mixed = materialise(own.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("h", "m"), "mixed")
    own = materialise(own.join(mixed, "h"), "own")
    x, y = own.where(F.col("m") <= FEW).alias("x"), own.where(F.col("m") <= FEW).alias("y")
    sized = _sized("x.n_shingles", "y.n_shingles", similarity)
    few = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c")) & sized).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    left = materialise(own.where(F.col("m") > FEW).select("rep", "n_shingles", "c").distinct(), "left")
    cross = few.unionAll(_across(left, docs, words, similarity)).distinct().join(stars, ["a", "b"], "left_anti")
    more = _verified(cross, reps, docs, words, k, similarity, slack)

    # Rows that share an id are one document, whatever their texts.
    same = facts.join(classes, "set_key").where("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    many = facts.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo < hi").select(F.col("doc_id").alias("b"))
    # What joins components is small, and its components are those of the components.
    extra = materialise(more.unionAll(same.join(many, "b").select("a", "b")), "extra")
    of = lambda x: first.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
    between = extra.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    second = components(between)
    drop(reps, lists, listed, pivots, stars, links, mixed, own, left, more, extra)
    once = classes.join(first, classes.rep == first.id, "left").select("set_key", F.coalesce("component", "rep").alias("c"))
    named = once.join(second, once.c == second.id, "left").select("set_key", F.coalesce("component", "c").alias("component_id"))
    out = facts.join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
