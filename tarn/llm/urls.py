"""URL filters: unigram Viterbi splits the names in hosts into words; naive Bayes scores the words of host and path.

1. Rules (host, path, verdict) decide first: a rule fits its host and all subdomains
   where the url's path starts with the rule's; the longest fitting rule wins (path and
   host together, then path, then host).
2. Words and their counts come from the visible text of all pages, joined with the
   substrings of the names, so no vocabulary is sent around; a name is split where
   the product of its words' frequencies is largest, unknown letters at a penalty.
   A word has at most ``LABEL`` letters, as a label of a host has; names may have more.
3. Multinomial naive Bayes scores the words of host and path, as often as they occur.
   The table has no labels, so it learns by expectation-maximisation from two weak
   ones: words of the lexicon count as ``STRENGTH`` blocked occurrences before any page
   is seen, and pages of which ``RATE`` of the visible words are in the lexicon begin as
   blocked whatever their host. Each round scores every page and counts its tokens for
   either class by its probability. So a word that keeps company with the lexicon's is
   learned, and a page with one such word among many harmless ones may pass.

Defined results: a null url, or one without ``://``, has an empty host and path and
no rule, and is allowed, as is a page of even odds; a null html is no text; repeated rows
and ids are judged one by one; columns other than id, url and html are left out, whatever
their names; an empty table gives no rows; digits count as the token ``0``; urls of any
length are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._common import drop, materialise

#: The rules, and seed words of unwanted hosts and of common web names.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
LEXICON = (
    "ads", "adserver", "adult", "bet", "bets", "betting", "casino", "cheap", "clickbait", "crack", "cracked", "dating", "doorway", "drugs", "escort", "fake", "gamble", "gambling", "hack", "hacked",
    "jackpot", "keygen", "loan", "lottery", "malware", "nude", "payday", "pharma", "phish", "phishing", "pills", "pirate", "poker", "popup", "porn", "prize", "replica", "roulette", "scam", "sex",
    "slots", "spam", "spyware", "tracker", "torrent", "viagra", "virus", "warez", "xxx",
)
COMMON = ("blog", "book", "cloud", "data", "farm", "free", "game", "home", "host", "mail", "mobile", "net", "news", "online", "page", "shop", "site", "store", "tech", "test", "web", "win", "wiki", "world")
#: Host labels that say nothing.
PLAIN = ("www", "m", "example")
#: Letters of a label at most; what a word of the lexicon weighs beforehand; the share of a page's words that makes it a bad example; rounds.
LABEL, STRENGTH, RATE, ROUNDS = 63, 5, 0.02, 4
#: Log odds of a page before anything is known of it.
BEGIN = -1.0


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(rest, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def visible_words(html: Column) -> Column:
    """The words of a page outside its tags, scripts and styles, in lower case."""
    text = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    return F.split(F.lower(text), r"[^\p{L}]+")


def word_counts(pages: DataFrame, html_col: str, least: int = 2, longest: int = LABEL) -> DataFrame:
    """(word, n) over the visible text of all pages and the seed words."""
    words = pages.select(F.explode(visible_words(pages[html_col])).alias("word")).where(F.length("word").between(least, longest))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seeds = pages.sparkSession.createDataFrame([(w, 1000) for w in sorted({*LEXICON, *COMMON})], "word string, n long")
    return counted.unionAll(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def segment(names: DataFrame, counts: DataFrame, least: int = 2, longest: int = LABEL) -> DataFrame:
    """(name, words) for distinct ``names`` (name): the most probable split."""
    places = names.where(F.length("name") >= least).select("name", F.explode(F.sequence(F.lit(1), F.length("name") - (least - 1))).alias("at"))
    lengths = F.sequence(F.lit(least), F.least(F.lit(longest), F.length("name") - F.col("at") + 1))
    parts = places.select("name", "at", F.explode(lengths).alias("size")).select("name", "at", "size", F.expr("substring(name, at, size)").alias("word"))
    total = materialise(counts, "words")
    sure = parts.join(total, "word").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "size", "n"))).alias("known"))
    mass = total.agg(F.sum("n").alias("mass"))
    whole = float(mass.first()[0] or 1)  # one number

    def run(batches):
        import math
        from collections import defaultdict

        import pyarrow as pa

        for batch in batches:
            out = []
            for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_start = defaultdict(list)
                for k in known or []:
                    by_start[k["at"] - 1].append((k["size"], math.log(k["n"] / whole)))
                n = len(name)
                best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
                for at in range(n):
                    for size, gain in (*by_start[at], (1, -math.log(whole) - math.log(10))):
                        if best[at] + gain > best[at + size]:
                            best[at + size], back[at + size] = best[at] + gain, size
                words, at = [], n
                while at:
                    words.append(name[at - back[at] : at])
                    at -= back[at]
                out.append(_merged(words[::-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return names.join(sure, "name", "left").select("name", "known").mapInArrow(run, "name string, words array<string>")


def _merged(words: list[str]) -> list[str]:
    """Neighbouring single letters are one unknown word."""
    out: list[str] = []
    for w in words:
        if len(w) == 1 and out and out[-1].startswith("\0"):
            out[-1] += w
        else:
            out.append("\0" + w if len(w) == 1 else w)
    return [w.lstrip("\0") for w in out]


def bayes(pages: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(tokens, score) for each distinct list of tokens of ``pages`` (tokens, bad: whether the page is a bad example): its log odds for being blocked."""
    lists = materialise(pages.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("examples")), "lists")
    each = materialise(lists.select("tokens", "n", "examples", F.explode("tokens").alias("token")).groupBy("tokens", "n", "examples", "token").agg(F.count(F.lit(1)).alias("times")), "token-counts")
    lexicon = [f"h:{w}" for w in LEXICON]
    seeds = F.when(F.col("token").isin(lexicon), F.lit(float(STRENGTH))).otherwise(F.lit(0.0))
    share = F.when(F.col("examples") > 0, F.col("examples") / F.col("n")).otherwise(F.lit(0.0))
    # Beforehand only the lexicon and the examples speak.
    said = F.size(F.filter("tokens", lambda t: t.isin(lexicon)))
    score = materialise(lists.select("tokens", F.round(F.lit(BEGIN) + said * math.log(STRENGTH + 1), 6).alias("score")), "scores")
    bad = F.greatest(1 / (1 + F.exp(-F.col("score"))), share)
    for _ in range(rounds):
        told = each.join(score, "tokens").withColumn("b", bad * F.col("n") * F.col("times")).withColumn("g", (1 - bad) * F.col("n") * F.col("times"))
        counts = materialise(told.groupBy("token").agg((F.sum("b") + F.first(seeds)).alias("b"), F.sum("g").alias("g")), "weights")
        sums = counts.agg(F.sum("b").alias("b"), F.sum("g").alias("g"), F.count(F.lit(1)).alias("kinds")).first()  # one row
        mass = lists.join(score, "tokens").agg(F.sum(bad * F.col("n")).alias("b"), F.sum("n").alias("n")).first()  # one row
        prior = math.log(((mass.b or 0) + 1) / ((mass.n or 0) - (mass.b or 0) + 1))
        total = (sums.b or 0) + (sums.kinds or 0) + 1, (sums.g or 0) + (sums.kinds or 0) + 1
        weight = counts.select("token", (F.log((F.col("b") + 1) / F.lit(total[0])) - F.log((F.col("g") + 1) / F.lit(total[1]))).alias("w"))
        new = each.join(weight, "token").groupBy("tokens").agg(F.round(F.sum(F.col("w") * F.col("times")) + F.lit(prior), 6).alias("score"))
        old, score = score, materialise(new, "scores")
        drop(counts, old)
    drop(lists, each)
    return score


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, score) for each row of ``pages``."""
    url = pages[url_col].cast("string")
    seen = visible_words(pages[html_col])
    held = F.size(F.filter(seen, lambda w: w.isin(list(LEXICON)))) >= F.greatest(F.lit(2.0), RATE * F.size(seen))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), held.alias("bad"))
    hosts = materialise(rows.where("host <> ''").select("host").distinct(), "hosts")
    # The last label is the top-level domain.
    runs = F.regexp_extract_all(F.lower(F.regexp_replace("host", r"\.[^.]*$", "")), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    named = hosts.select("host", F.posexplode(F.filter(runs, lambda x: ~x.isin(*PLAIN))).alias("at", "name"))
    digits = F.col("name").rlike(r"^\p{N}")
    split = materialise(segment(named.where(~digits).select("name").distinct(), word_counts(pages, html_col)), "names")
    each = named.where(~digits).join(split, "name").select("host", "at", "words").unionAll(named.where(digits).select("host", "at", F.array(F.lit("0"))))
    words = materialise(each.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words")), "host-words")

    paths = F.transform(F.filter(F.split(F.lower(F.col("path")), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.when(x.rlike(r"^\p{N}+$"), "0").otherwise(x))
    none = F.array().cast("array<string>")
    told = rows.join(words, "host", "left").select("page_id", "host", "path", "bad", F.coalesce("words", none).alias("words"), F.coalesce(paths, none).alias("path_words"))
    tokens = F.array_sort(F.concat(F.transform("words", lambda w: F.concat(F.lit("h:"), w)), F.transform("path_words", lambda w: F.concat(F.lit("p:"), w))))
    told = materialise(told.select("page_id", "host", "path", "words", "bad", tokens.alias("tokens")), "told")
    ruled = told.join(bayes(told.where(F.size("tokens") > 0).select("tokens", "bad")), "tokens", "left").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.coalesce("score", F.lit(0.0)) > 0, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "words", "score")
