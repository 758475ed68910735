"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Candidates are the matches of strict patterns (the base kinds) and of loose ones
(obfuscated addresses, local numbers, titles before names). Five labelers vote for,
against, or abstain on every candidate: the strict pattern with its checks (Luhn,
octets, digits), a variant of each kind's pattern that says what is well formed, a fixed
list (issuer prefixes, domain endings, given names), a gazetteer of the corpus (domains,
area codes, issuers and names that strict matches or their context support twice), and
the words around it. The votes are counted over all documents; there are at most kinds x
243 patterns of votes, whatever the data, and on these counts expectation-maximisation
estimates each labeler's reliability and each candidate's probability without labels.
With these as soft labels a logistic span classifier is trained on votes and shape; it
alone decides which candidates become spans. Base spans always stay.

Only DataFrame functions run on the rows; the driver sees the counts alone.

Defined results: a null text is an empty one with no spans; every row has its own
result, repeated ones and such without an id too; a candidate of even odds becomes a
span; spans that overlap a base span are no candidates; columns other than id and text
are left out, whatever their names; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._common import MOST_IDS, materialise, texts
from tarn.llm.spans import clean, joined, with_matches

#: The base patterns. Possessive quantifiers and starts at the beginnings of runs (or where the last match ended) find the same matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora)\b\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?",
}
ALL_KINDS = (*KINDS, "ssn", "name")
#: Endings of common domains, issuer prefixes, toll-free and other real area codes' first digits, given names.
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu"
GIVEN = "John|Mary|James|Anna|Peter|Maria|Paul|Laura|Thomas|Julia|Hans|Jean|Pierre|Marie|Jose|Carmen|Carlos|Luis|Klaus|Sabine"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|correo|courriel|kontakt|mailto)[^\n]{0,25}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|addr|login|from)[^\n]{0,25}$",
    "card": r"(?i)(?:card|visa|master|payment|tarjeta|carte|karte)[^\n]{0,25}$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|cell|tel[eé]fono|anruf)[^\n]{0,25}$",
    "ssn": r"(?i)(?:ssn|social|security|insurance|seguro)[^\n]{0,25}$",
    "name": r"(?i)(?:dear|by|from|contact|signed|name|nombre|nom)[^\n]{0,15}$",
}
AGAINST = r"(?i)\b(?:version|isbn|section|chapter|page|serial|build|order|part|item|invoice|model|ticket)[^\n]{0,12}$"
#: What is well formed, by kind: patterns for the normal form of a value.
FORMS = {
    "email": r"^[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.))*(?<=[A-Za-z0-9])@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$",
    "card": r"^[0-9]{16,19}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?$",
    "phone": r"^1?[2-9][0-9]{2}[2-9][0-9]{6}$|^[2-9][0-9]{9,13}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "name": r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, k: a + F.when(k % 2 == 1, F.substring(digits, -k, 1).cast("int")).otherwise(F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), F.substring(digits, -k, 1).cast("int") + 1)),
    )
    return total % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The checks of a base match."""
    digits = F.regexp_replace(value, F.lit("[^0-9]"), F.lit(""))
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _gazetteer(kind: str, value: Column) -> Column:
    """1 for, 0 against, -1 abstains."""
    digits = F.regexp_replace(value, F.lit("[^0-9]"), F.lit(""))
    if kind == "email":
        return F.when(value.rlike(rf"(?i)[.\])\x20](?:{ENDINGS})$"), 1).otherwise(-1)
    if kind == "card":
        return F.when(digits.rlike("^(?:4|5[1-5]|2[2-7]|6|3[47])"), 1).otherwise(0)
    if kind == "ip":
        return F.when(value.rlike(r"^0+\.|\.0+$"), 0).otherwise(-1)
    if kind == "phone":
        return F.when(digits.rlike("^(?:1?[2-9][0-9]{2}[2-9][0-9]{6})$"), 1).otherwise(-1)
    if kind == "ssn":
        return F.when(digits.rlike("^(?:000|666|9)|^.{3}00|0000$"), 0).otherwise(-1)
    return F.when(value.rlike(rf"(?:^|\x20)(?:{GIVEN})(?:\x20|$)"), 1).otherwise(-1)


def _normal(kind: str, value: Column) -> Column:
    """A value as the forms have it: obfuscations undone, a phone's digits alone."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(value, r"\x20?[\[(](?:at|AT)[\])]\x20?", "@"), r"\x20?[\[(](?:dot|DOT)[\])]\x20?", ".")
    return F.regexp_replace(value, F.lit("[^0-9]"), F.lit("")) if kind == "phone" else value


def _key(kind: str, normal: Column) -> Column:
    """What the gazetteer of the corpus knows a value by; empty where it has none."""
    if kind == "email":
        return F.lower(F.substring_index(normal, "@", -1))
    if kind == "ip":
        return F.substring_index(normal, ".", 2)
    if kind == "card":
        return F.left(F.regexp_replace(normal, F.lit("[^0-9]"), F.lit("")), F.lit(6))
    if kind == "phone":
        return F.left(F.right(normal, F.lit(10)), F.lit(3))
    return F.regexp_extract(normal, r"\x20(\p{Lu}\p{Ll}+)", 1) if kind == "name" else F.lit("")


def _votes(kind: str, strict: bool) -> object:
    def of(s):
        context = F.when(s["before"].rlike(AGAINST), 0).when(s["before"].rlike(CONTEXT[kind]), 1).otherwise(-1)
        normal = _normal(kind, s["value"])
        # Not every name has two words, nor every number a plan that is known.
        form = F.when(normal.rlike(FORMS[kind]), 1).otherwise(-1 if kind in ("name", "phone") else 0)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(strict).alias("strict"),
            (F.when(passes(kind, s["value"]), 1).otherwise(0) if strict else F.lit(-1)).cast("int").alias("v1"),
            form.cast("int").alias("v2"), _gazetteer(kind, s["value"]).cast("int").alias("v3"), _key(kind, normal).alias("key"), context.cast("int").alias("v5"),
            F.least(F.lit(3), F.floor(F.length(s["value"]) / 8)).cast("int").alias("size"),
            (~s["before"].rlike(r"[\p{L}0-9]$") & ~s["after"].rlike(r"^[\p{L}0-9]")).alias("apart"),
        )

    return of


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): every candidate of a row with its votes and shape. One reading of each text."""
    docs = docs.select("doc_id", clean(F.col("text")).alias("text"))
    guards = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike("[0-9](?:[ -]?[0-9]){15}")}
    parts = []
    for kind, pattern in PATTERNS.items():
        docs = with_matches(docs, "text", f"s_{kind}", pattern, guards[kind])
        # Most matches of the card pattern are plain numbers; those of other lengths are no candidates.
        wanted = F.filter(f"s_{kind}", lambda s: F.length(F.regexp_replace(s["value"], F.lit("[^0-9]"), F.lit(""))).between(16, 19)) if kind == "card" else F.col(f"s_{kind}")
        parts.append(F.transform(wanted, _votes(kind, True)))
    loose = {"email": F.col("text").rlike(r"(?i)[\[(]at[\])]"), "phone": F.col("text").rlike("[0-9]{3}[.-][0-9]{4}"), "ssn": F.col("text").rlike("[0-9]-[0-9]{2}-[0-9]"), "name": F.col("text").rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señora?)\b")}
    for kind, pattern in LOOSE.items():
        docs = with_matches(docs, "text", f"l_{kind}", pattern, loose[kind])
        parts.append(F.transform(f"l_{kind}", _votes(kind, False)))
    return docs.select("doc_id", F.concat(*parts).alias("found"))


VOTES = ("v1", "v2", "v3", "v4", "v5")
LABELERS = ("strict", "form", "listed", "corpus", "context")
FIELDS = ("start", "end", "kind", "strict", "v1", "v2", "v3", "v4", "v5", "size", "apart")


def with_corpus(seen: DataFrame) -> DataFrame:
    """(row, doc_id, found) with the fourth vote: for, where two candidates or more of that key pass the strict pattern or stand in a fitting context."""
    each = seen.where(F.size("found") > 0).select("row", F.posexplode("found").alias("at", "f"))
    support = each.where("f.key <> ''").groupBy("f.kind", "f.key").agg(F.count_if((F.col("f.v1") == 1) | (F.col("f.v5") == 1)).alias("n")).where("n > 1").select("kind", "key", F.lit(1).alias("v4"))
    known = materialise(support, "gazetteer")
    few = known.limit(MOST_IDS + 1).count() <= MOST_IDS
    voted = each.select("row", "at", "f.*").join(F.broadcast(known) if few else known, ["kind", "key"], "left").withColumn("v4", F.coalesce("v4", F.lit(-1)))
    again = voted.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", *FIELDS))).alias("found"))
    none = seen.where(F.size("found") == 0).select("doc_id", F.array().cast(again.schema["found"].dataType).alias("found"))
    return seen.where(F.size("found") > 0).select("row", "doc_id").join(again, "row").select("doc_id", "found").unionAll(none)


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 40, prior: float = 0.3) -> tuple[dict, dict, dict]:
    """Expectation-maximisation over counts of (kind, votes, n): priors by kind, each labeler's votes given truth, posteriors.

    A labeler's table is P(vote | truth) for votes 1, 0, -1, smoothed; it starts from
    the belief that labelers are right more often than not, and that most candidates
    are none.
    """
    priors = {kind: prior for kind, _, _ in counts}
    many = range(len(counts[0][1])) if counts else range(0)
    table = {(kind, k): {True: {1: 0.6, 0: 0.1, -1: 0.3}, False: {1: 0.1, 0: 0.4, -1: 0.5}} for kind in priors for k in many}
    posterior: dict = {}
    for _ in range(rounds):
        for kind, votes, _ in counts:
            yes, no = priors[kind], 1 - priors[kind]
            for k, v in enumerate(votes):
                yes *= table[kind, k][True][v]
                no *= table[kind, k][False][v]
            posterior[kind, votes] = yes / (yes + no)
        for kind in priors:
            own = [(votes, n, posterior[kind, votes]) for x, votes, n in counts if x == kind]
            total, sure = sum(n for _, n, _ in own), sum(n * p for _, n, p in own)
            priors[kind] = (sure + 2 * prior) / (total + 2)
            for k in many:
                for truth in (True, False):
                    start = {1: 2.0, 0: 0.5, -1: 1.0} if truth else {1: 0.5, 0: 2.0, -1: 1.0}
                    mass = {v: start[v] + sum(n * (p if truth else 1 - p) for votes, n, p in own if votes[k] == v) for v in (1, 0, -1)}
                    whole = sum(mass.values())
                    table[kind, k][truth] = {v: m / whole for v, m in mass.items()}
    return priors, table, posterior


def features(kind: str, votes: tuple[int, ...], size: int, apart: bool) -> list[str]:
    return [f"kind={kind}", *(f"{kind}.{name}={v}" for name, v in zip(LABELERS, votes, strict=True)), *(f"{name}={v}" for name, v in zip(LABELERS, votes, strict=True)), f"size={size}", f"apart={apart}"]


def train(rows: list[tuple[list[str], float, int]], rounds: int = 300, rate: float = 0.5, decay: float = 0.01) -> dict[str, float]:
    """Logistic weights from (features, soft label, count), by gradient ascent; a count weighs as its root, so rare shapes are heard."""
    rows = [(names, label, math.sqrt(n)) for names, label, n in rows]
    total = sum(n for _, _, n in rows) or 1
    weights: dict[str, float] = {}
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for names, label, n in rows:
            p = probability(weights, names)
            for x in names:
                slope[x] = slope.get(x, 0.0) + (label - p) * n / total
        for x, s in slope.items():
            weights[x] = weights.get(x, 0.0) + rate * (s - decay * weights.get(x, 0.0) / 10)
    return weights


def probability(weights: dict[str, float], names: list[str]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(x, 0.0) for x in names)))))


def decide(shapes: list[tuple[str, tuple[int, ...], int, bool, int]], threshold: float = 0.5) -> set[tuple[str, tuple[int, ...], int, bool]]:
    """The shapes (kind, votes, size, apart) of (..., count) that the trained classifier takes for personal data."""
    counts: dict = {}
    for kind, votes, _, _, n in shapes:
        counts[kind, votes] = counts.get((kind, votes), 0) + n
    _, _, posterior = reliabilities([(k, v, n) for (k, v), n in sorted(counts.items())])
    weights = train([(features(k, v, size, apart), posterior[k, v], n) for k, v, size, apart, n in sorted(shapes)])
    return {(k, v, size, apart) for k, v, size, apart, _ in shapes if probability(weights, features(k, v, size, apart)) >= threshold}


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, base, found): base spans, and all spans with the classifier's; each array by kind, then start."""
    # The number of a row stays what it is once it is written.
    first = materialise(candidates(texts(docs, id_col, text_col)).withColumn("row", F.monotonically_increasing_id()), "pii")
    seen = materialise(with_corpus(first), "votes")
    shapes = seen.select(F.explode("found").alias("f")).groupBy("f.kind", *[f"f.{v}" for v in VOTES], "f.size", "f.apart").count().collect()  # at most kinds x 243 votes x 8 shapes
    taken = decide([(r.kind, tuple(r[v] for v in VOTES), r["size"], r.apart, r["count"]) for r in shapes], threshold)
    accepted = sorted("/".join(map(str, (k, *v, size, apart))).lower() for k, v, size, apart in taken)
    is_base = lambda s: s["strict"] & (s["v1"] == 1)
    key = lambda s: F.concat_ws("/", s["kind"], *[s[v].cast("string") for v in VOTES], s["size"].cast("string"), s["apart"].cast("string"))
    place = lambda s: F.struct(F.array_position(F.lit(list(ALL_KINDS)), s["kind"]).alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    base = seen.withColumn("base", F.filter("found", is_base))
    added = F.filter("found", lambda s: ~is_base(s) & (key(s).isin(accepted) if accepted else F.lit(False)) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return base.select("doc_id", F.array_sort(F.transform("base", place)).alias("base"), F.array_distinct(F.array_sort(F.transform(F.concat("base", added), place))).alias("found"))


def report(found: DataFrame) -> DataFrame:
    of = lambda kind: lambda s: s["kind"] == kind  # noqa: E731  a second parameter would be the position
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
