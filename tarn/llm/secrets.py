"""Secret scans over an inverted index of character trigrams.

From each rule's regular expression a Boolean query over trigrams is derived: what any
match must contain. The index holds, for each trigram that some query names, the
documents that contain it; its size is bounded by trigrams times documents. The
postings of a conjunction are intersected, and only the documents that satisfy a
rule's query are verified by the rule itself. Rules without a mandatory trigram scan
every document. Trigrams are folded to lower case on both sides, so a query never
misses a match in either case.

Only DataFrame functions run on the rows.

Defined results: a null text is an empty one; repeated rows and rows that share an id
are scanned one by one (a candidate id selects all its rows); rows with a null id are
scanned in full; spans that start at one place come in the order of the rules; columns
other than id and text are left out, whatever their names, but for ``keep``; an empty
table gives no rows; texts of any length are scanned whole.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._common import MOST_IDS, materialise
from tarn.llm.spans import clean, joined, with_matches


@dataclass(frozen=True)
class Rule:
    """A pattern in the common subset of Python's and Java's syntax; ``java`` may give a faster equal for Java.

    ``group`` with ``least`` drops matches whose group is shorter. The faster equals
    of the base rules skip runs that are too short, which no longer match can share.
    """

    kind: str
    pattern: str
    base: bool = False
    group: int = 0
    least: int = 0
    java: str | None = None


#: The three base rules.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", True, 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", True, 0, 24, r"(?<![0-9a-f])[0-9a-f]{24,}+"),
)
#: Public token formats beside the base rules.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

MOST_STRINGS = 64


def _strings(node) -> set[str] | None:
    """The folded strings a parsed node can match, if they are few; else None."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(x[0] is sre.LITERAL for x in arg) and len(arg) <= 8:
        return {chr(x[1]).lower() for x in arg}
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op is sre.MAX_REPEAT and arg[1] <= 2:
        inner = _sequence_strings(arg[2])
        return None if inner is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(inner, repeat=n)}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _strings(node)
        if found is None or len(out) * len(found) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in found}
    return out


def _conjoin(x: list[frozenset], y: list[frozenset]) -> list[frozenset]:
    return _least([a | b for a in x for b in y])


def _least(terms: list[frozenset]) -> list[frozenset]:
    """Without conjunctions that others imply."""
    kept: list[frozenset] = []
    for t in sorted(set(terms), key=lambda t: (len(t), sorted(t))):
        if not any(k <= t for k in kept):
            kept.append(t)
    return kept


def _query(nodes) -> list[frozenset]:
    """A disjunction of conjunctions of trigrams that holds for every match; [frozenset()] holds always."""
    always = [frozenset()]
    out, runs = always, {""}

    def flush() -> None:
        nonlocal out, runs
        terms = _least([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in runs])
        out, runs = _conjoin(out, terms) if len(out) * len(terms) <= MOST_STRINGS else out, {""}

    for node in nodes:
        found = _strings(node)
        if found is not None and len(runs) * len(found) <= MOST_STRINGS:
            runs = {a + b for a in runs for b in found}
            continue
        flush()
        op, arg = node
        inner = always
        if found is not None:
            runs = found
        elif op is sre.SUBPATTERN:
            inner = _query(arg[3])
        elif op is sre.BRANCH:
            inner = _least([t for x in arg[1] for t in _query(x)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            inner = _query(arg[2])
        if len(out) * len(inner) <= MOST_STRINGS:
            out = _conjoin(out, inner)
    flush()
    return out


def trigram_query(pattern: str) -> list[frozenset]:
    """Conjunctions of folded trigrams, one of which every matching text contains whole; [] if there is no such condition."""
    found = _query(sre.parse(pattern))
    return [] if frozenset() in found else found


def postings(docs: DataFrame, trigrams: list[str], text: str) -> DataFrame:
    """The inverted index: (trigram, doc_id) for each of the trigrams a document contains."""
    low = docs.select("doc_id", F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset]]) -> DataFrame:
    """(doc_id, rules): the rules whose query a document satisfies, by intersecting the postings of each conjunction.

    The table of conjunctions that goes to every executor is as large as the rule set, whatever the data.
    """
    terms = [(rule, n, bit, t, (1 << len(c)) - 1) for rule, q in queries.items() for n, c in enumerate(q) for bit, t in enumerate(sorted(c))]
    parts: dict[str, list] = {}
    for rule, n, bit, t, full in terms:
        parts.setdefault(t, []).append((rule, n, 1 << bit, full))
    wanted = index.sparkSession.createDataFrame([(t, x) for t, x in parts.items()], "trigram string, parts array<struct<rule:string,term:int,bit:long,full:long>>")
    hits = index.join(F.broadcast(wanted), "trigram").select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.*")
    whole = hits.groupBy("doc_id", "rule", "term").agg(F.bit_or("bit").alias("bits"), F.first("full").alias("full")).where("bits = full")
    return whole.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, found): for each row all spans (kind, start, end, value), by start, then by the order of the rules.

    The text is as scanned (see ``clean``). The row's columns in ``keep`` come along as the struct ``row``.
    """
    row = [F.struct(*keep).alias("row")] if keep else []
    carried = ["row"] if keep else []
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *row)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), *carried)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    assert all(len(c) < 63 for q in queries.values() for c in q)
    if queries:
        # Candidates are few, and written once, so texts needn't move; if they aren't few, rows without an id stay out of the join.
        trigrams = sorted({t for q in queries.values() for c in q for t in c})
        named = docs.where("doc_id is not null")
        found = materialise(candidates(postings(named, trigrams, "text"), queries), "candidates")
        if found.limit(MOST_IDS + 1).count() <= MOST_IDS:
            docs = docs.join(F.broadcast(found), "doc_id", "left")
        else:
            nameless = docs.where("doc_id is null").withColumn("rules", F.lit(None).cast("array<string>"))
            docs = named.join(found, "doc_id", "left").select(*nameless.columns).unionAll(nameless)
    else:
        docs = docs.withColumn("rules", F.lit(None).cast("array<string>"))
    found = []

    def enough(r: Rule):
        return lambda s: F.length(F.regexp_extract(s["value"], r.pattern, r.group)) >= r.least if r.group else F.length(s["value"]) >= r.least

    def place(n: int, r: Rule):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"), F.lit(r.kind).alias("kind"), s["value"].alias("value"))

    for n, r in enumerate(rules):
        guard = None
        if r.kind in queries:
            guard = F.coalesce(F.array_contains("rules", r.kind), F.lit(False)) | F.col("doc_id").isNull()
        docs = with_matches(docs, "text", f"m{n}", r.java or r.pattern, guard)
        kept = F.filter(f"m{n}", enough(r)) if r.least else F.col(f"m{n}")
        found.append(F.transform(kept, place(n, r)))
    return docs.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("found"), *carried)


def report(found: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """The digest of a scan: counts and a hash of the base spans, and all spans as text."""
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in rules if r.base]))
    of = lambda kind: lambda s: s["kind"] == kind  # noqa: E731  a second parameter would be the position
    counts = [F.size(F.filter("found", of(r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def masked(text: str, found: str) -> Column:
    """The text with every found span replaced by its kind in brackets; spans that overlap an earlier one are part of it."""
    whole = F.expr(f"""
        aggregate({found}, named_struct('at', 0, 'out', cast(array() as array<string>)),
          (a, s) -> if(s.end <= a.at, a, named_struct('at', s.end,
            'out', concat(a.out, array(if(s.start >= a.at, substring({text}, a.at + 1, s.start - a.at), ''), if(s.start >= a.at, concat('[', s.kind, ']'), ''))))),
          a -> array_join(array_append(a.out, substring({text}, a.at + 1)), ''))""")
    return whole
