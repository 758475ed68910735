"""The registered queries of the scan, each with the same query in SQL where SQL can say it.

Driver tables hold few secrets, so some queries plant tokens from ``doc_id`` first, in
the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions import gates
from tarn.functions.rules import built_in, portable
from tarn.operators import history, relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BY_NAME = {r.name: r for r in built_in()}
GENERIC = portable(_BY_NAME["generic-api-key"].pattern, "java")
#: Whether the pattern can match at all, without its dear beginning.
GENERIC_ANCHOR = r"(?i)(?:access|auth|api|credential|creds|key|passw(?:or)?d|secret|token)"
#: The formats of three of the built-in rules' tokens, in the syntax that both engines read.
PAT, AWS = "ghp_[0-9a-zA-Z]{36}", "(?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[A-Z2-7]{16}"
JWT = r"eyJ[a-zA-Z0-9]{16,}\.eyJ[a-zA-Z0-9/_-]{16,}\.[a-zA-Z0-9/_-]{10,}"


def _text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _hex(x, salt=""):
    return F.md5(F.concat(x.cast("string"), F.lit(salt)).cast("binary"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token, text): documents with a token planted behind the text."""
    token = F.concat(F.lit("ghp_"), F.substring(F.concat(_hex(F.col("doc_id")), _hex(F.col("doc_id"), "x")), 1, 36))
    return _text(spark, sf_dir).select("doc_id", token.alias("token"), F.concat("text", F.lit("\ngithub_token = \""), token, F.lit("\"\n")).alias("text"))


PLANTED = """p AS (SELECT doc_id, token, text || chr(10) || 'github_token = "' || token || '"' || chr(10) AS text FROM
 (SELECT doc_id, text, 'ghp_' || substr(md5(doc_id::VARCHAR) || md5(doc_id::VARCHAR || 'x'), 1, 36) AS token FROM documents))"""


GENERIC_RE2 = portable(_BY_NAME["generic-api-key"].pattern, "re2").replace("'", "''")


@query(f"""SELECT doc_id, sha256(regexp_extract(text, '{GENERIC_RE2}', 1)) AS norm_hash FROM documents WHERE regexp_matches(text, '{GENERIC_RE2}')""")
def scan_generic_api_key(spark, sf_dir):
    """O-regex-match: the one built-in rule that driver text fires, behind a cheap literal reject."""
    docs = _text(spark, sf_dir).where(F.col("text").rlike(GENERIC_ANCHOR)).where(F.col("text").rlike(r"[=>:,|]"))
    found = docs.withColumn("secret", F.regexp_extract("text", GENERIC, 1)).where("secret <> ''")
    return found.select("doc_id", F.sha2("secret", 256).alias("norm_hash"))


@query(f"WITH {PLANTED} SELECT doc_id, unnest(regexp_extract_all(text, '{PAT}')) AS secret FROM p")
def scan_planted_pat(spark, sf_dir):
    return planted(spark, sf_dir).where(F.contains("text", F.lit("ghp_"))).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PAT), F.lit(0))).alias("secret"))


@query(f"SELECT doc_id, unnest(regexp_extract_all(text || ' AKIA' || upper(translate(substr(md5(doc_id::VARCHAR), 1, 16), '0189', 'WXYZ')) || ' ', '{AWS}')) AS secret FROM documents")
def scan_planted_aws(spark, sf_dir):
    token = F.upper(F.translate(F.substring(_hex(F.col("doc_id")), 1, 16), "0189", "WXYZ"))
    docs = _text(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" AKIA"), token, F.lit(" ")))
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(AWS), F.lit(0))).alias("secret"))


@query(f"SELECT doc_id, regexp_extract(text || ' eyJ' || md5(doc_id::VARCHAR) || '.eyJ' || md5(doc_id::VARCHAR || 'x') || '.' || md5(doc_id::VARCHAR || 'y') || ' ', '{JWT}') AS secret FROM documents")
def scan_planted_jwt(spark, sf_dir):
    d = F.col("doc_id")
    text = F.concat("text", F.lit(" eyJ"), _hex(d), F.lit(".eyJ"), _hex(d, "x"), F.lit("."), _hex(d, "y"), F.lit(" "))
    return _text(spark, sf_dir).select("doc_id", F.regexp_extract(text, JWT, 0).alias("secret"))


INLINE = (("assign", ("password", "token")), ("aws", ("AKIA",)), ("mail", ("@", "mailto")))
_INLINE_SQL = "r AS (SELECT * FROM (VALUES ('assign', ['password', 'token']), ('aws', ['AKIA']), ('mail', ['@', 'mailto'])) t(rule, anchors))"


@query(f"WITH {_INLINE_SQL} SELECT doc_id, rule FROM documents, r WHERE len(list_filter(anchors, lambda a: contains(text, a))) > 0")
def rule_join_any_anchor(spark, sf_dir):
    rules = spark.createDataFrame([(a, list(b)) for a, b in INLINE], "rule string, anchors array<string>")
    return relational.rules_by_anchor(_text(spark, sf_dir), rules, "text").select("doc_id", "rule")


@query("SELECT doc_id FROM documents WHERE contains(text, 'password') OR contains(text, 'token') OR contains(text, 'AKIA')")
def keywords_any(spark, sf_dir):
    return _text(spark, sf_dir).where(F.exists(F.lit(["password", "token", "AKIA"]), lambda a: F.contains("text", a))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'token') AND contains(text, ' = ')")
def confirm_all(spark, sf_dir):
    return _text(spark, sf_dir).where(F.forall(F.lit(["token", " = "]), lambda a: F.contains("text", a))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR contains(text, 'AKIA')")
def must_contain(spark, sf_dir):
    """O-must-contain: every third document has the literal planted behind its text."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" AKIA"))).otherwise(F.col("text"))
    return _text(spark, sf_dir).where(F.contains(text, F.lit("AKIA"))).select("doc_id")


@query(f"""WITH {PLANTED}, c AS (SELECT doc_id, unnest(string_split(token, '')) AS ch FROM p), n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY ALL),
e AS (SELECT doc_id, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) AS entropy FROM n GROUP BY doc_id) SELECT doc_id, entropy, entropy >= 3.0 AS passes FROM e""")
def entropy_gate(spark, sf_dir):
    e = F.round(gates.entropy(F.col("token")), 6)
    return planted(spark, sf_dir).select("doc_id", e.alias("entropy"), (e >= 3.0).alias("passes"))


_PAIR = r'([a-z_]+) = "(gh[a-z]_[0-9a-zA-Z]{36})?'


@query(f"""WITH {PLANTED} SELECT doc_id, coalesce(nullif(regexp_extract(text, '{_PAIR}', 2), ''), nullif(regexp_extract(text, '{_PAIR}', 1), ''), regexp_extract(text, '{_PAIR}', 0)) AS secret FROM p""")
def secret_extract(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", gates.secret(F.col("text"), _PAIR, 2).alias("secret"))


@query(f"""WITH {PLANTED}, l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, token))[1] AS line, token FROM p),
b AS (SELECT doc_id, substr(line, 1, position(token IN line) - 1) AS before FROM l) SELECT doc_id, regexp_matches(before, '[=:>]') AND contains(before, 'token') AS passes FROM b""")
def context_same_line(spark, sf_dir):
    docs = planted(spark, sf_dir)
    line = F.element_at(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.col("token"))), 1)
    before = F.expr("split_part(line, token, 1)")
    return docs.withColumn("line", line).select("doc_id", (before.rlike("[=:>]") & F.contains(before, F.lit("token"))).alias("passes"))


@query(f"""WITH {PLANTED}, b AS (SELECT doc_id, text, token, position(token IN text) AS pos FROM p) SELECT doc_id, substr(text, pos - 1, 1) = substr(text, pos + 40, 1) AND substr(text, pos - 1, 1) IN ('"', '''', '`') AS quoted FROM b""")
def context_quoted(spark, sf_dir):
    docs = planted(spark, sf_dir).withColumn("at", F.expr("instr(text, token)"))
    return docs.select("doc_id", gates.quoted(F.col("text"), F.col("at"), F.lit(40)).alias("quoted"))


_SHAPE = r"""^[^=:>]*[=:>][ \t"'`=>]*[A-Za-z0-9_.-]{10,}"""


@query("SELECT doc_id, regexp_matches(text, '" + _SHAPE.replace("'", "''") + "') AS shaped FROM documents")
def assign_shape(spark, sf_dir):
    return _text(spark, sf_dir).select("doc_id", gates.assignment_shape(F.col("text")).alias("shaped"))


def _decoder(decode):
    """A decoder of the scan as a function of columns, in Arrow batches."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: decode(v.encode()).decode("utf-8", "replace"), na_action="ignore")

    return run


@query(f"WITH {PLANTED} SELECT doc_id, regexp_extract(url_decode(replace(token, '_', '%5F')), '{PAT}') AS secret FROM p")
def url_decode_scan(spark, sf_dir):
    from tarn.functions import codecs

    encoded = planted(spark, sf_dir).select("doc_id", F.replace("token", F.lit("_"), F.lit("%5F")).alias("e"))
    return encoded.select("doc_id", F.regexp_extract(_decoder(lambda x: codecs.url_decode(x).data)("e"), PAT, 0).alias("secret"))


@query(f"WITH {PLANTED} SELECT doc_id, regexp_extract(decode(from_base64(to_base64(encode(token)))), '{PAT}') AS secret FROM p")
def b64_decode_scan(spark, sf_dir):
    encoded = planted(spark, sf_dir).select("doc_id", F.translate(F.base64("token"), "+/", "-_").alias("e"))
    from tarn.functions import codecs

    return encoded.select("doc_id", F.regexp_extract(_decoder(lambda x: codecs.base64_decode(x).data)("e"), PAT, 0).alias("secret"))


@query(f"""WITH {PLANTED}, s AS (SELECT doc_id, token, substr('abc', 1, (doc_id % 4)::BIGINT) || to_base64(encode(token)) AS e FROM p), a AS (SELECT doc_id, token, e, unnest(range(4)) AS shift FROM s)
SELECT doc_id, shift FROM a WHERE substr(e, shift + 1) = to_base64(encode(token))""")
def b64_align_shift(spark, sf_dir):
    d = F.col("doc_id") % 4
    shifted = planted(spark, sf_dir).select("doc_id", "token", F.concat(F.left(F.lit("abc"), d.cast("int")), F.base64("token")).alias("e")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shift"))
    same = F.try_to_binary(F.expr("substring(e, shift + 1)"), F.lit("base64")) == F.col("token").cast("binary")
    return shifted.where(same).select("doc_id", F.col("shift").cast("long").alias("shift"))


_HITS = "h AS (SELECT user_id, epoch_us(ts) // 60000000 AS start, epoch_us(ts) // 60000000 + 30 AS e FROM events)"


@query(f"""WITH {_HITS}, a AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM h),
i AS (SELECT *, sum(CASE WHEN r IS NULL OR start > r + 64 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, e) AS g FROM a)
SELECT user_id, min(start) AS start, max(e) AS "end", count(*) AS hits FROM i GROUP BY user_id, g""")
def window_merge(spark, sf_dir):
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000)
    hits = table(spark, sf_dir, "events").select("user_id", minute.alias("start"), (minute + 30).alias("end"))
    return relational.merge_windows(hits, ["user_id"], gap=64)


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS pos FROM documents)
SELECT doc_id, pos - least(pos, 100) AS base_offset, least(pos, 100) AS prefix_len, sha256(substr(text, pos - least(pos, 100) + 1, 1000 + least(pos, 100))) AS chunk_hash FROM c""")
def chunk_explode(spark, sf_dir):
    docs = _text(spark, sf_dir).select("doc_id", "text", F.explode(F.expr("sequence(0L, greatest(0L, length(text) - 1L), 1000L)")).alias("at")).withColumn("prefix_len", F.least("at", F.lit(100)))
    piece = F.expr("substring(text, cast(at - prefix_len + 1 as int), cast(1000 + prefix_len as int))")
    return docs.select("doc_id", (F.col("at") - F.col("prefix_len")).alias("base_offset"), F.col("prefix_len").cast("long").alias("prefix_len"), F.sha2(piece, 256).alias("chunk_hash"))


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS pos FROM documents),
d AS (SELECT doc_id, pos - least(pos, 100) AS base, least(pos, 100) AS prefix, substr(text, pos - least(pos, 100) + 1, 1000 + least(pos, 100)) AS piece FROM c),
f AS (SELECT doc_id, base, prefix, piece, unnest(range(1, length(piece))) AS p FROM d) SELECT doc_id, base + p - 1 AS start FROM f WHERE substr(piece, p, 2) = 'th' AND p + 1 > prefix""")
def drop_prefix(spark, sf_dir):
    """O-drop-prefix: every hit of a chunk, less those that end in what it carries from the chunk before; each hit of a document comes once."""
    docs = _text(spark, sf_dir).select("doc_id", "text", F.explode(F.expr("sequence(0L, greatest(0L, length(text) - 1L), 1000L)")).alias("at")).withColumn("prefix", F.least("at", F.lit(100)))
    piece = F.expr("substring(text, cast(at - prefix + 1 as int), cast(1000 + prefix as int))")
    # Places of the hits: the lengths of what the hits part, summed up.
    parts = F.expr("transform(slice(split(piece, 'th', -1), 1, size(split(piece, 'th', -1)) - 1), x -> length(x))")
    ends = F.expr("aggregate(parts, named_struct('at', 0, 'all', cast(array() as array<int>)), (s, x) -> named_struct('at', s.at + x + 2, 'all', array_append(s.all, s.at + x + 1)), s -> s.all)")
    found = docs.withColumn("piece", piece).withColumn("parts", parts).select("doc_id", "at", "prefix", F.explode(ends).alias("p"))
    return found.where(F.col("p") + 1 > F.col("prefix")).select("doc_id", (F.col("at") - F.col("prefix") + F.col("p") - 1).alias("start"))


@query(f"""WITH {PLANTED}, f AS (SELECT doc_id, token, false AS decoded, 40 + doc_id % 3 AS root_end FROM p UNION ALL SELECT doc_id, token, true, 40 + doc_id % 5 FROM p WHERE doc_id % 2 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY decoded DESC, root_end DESC) AS k FROM f) SELECT doc_id, token, decoded, root_end FROM n WHERE k = 1""")
def dedupe_prefer(spark, sf_dir):
    p = planted(spark, sf_dir)
    raw = p.select("doc_id", "token", F.lit(False).alias("decoded"), (40 + F.col("doc_id") % 3).alias("root_end"))
    found = raw.unionAll(p.where("doc_id % 2 = 0").select("doc_id", "token", F.lit(True), 40 + F.col("doc_id") % 5))
    best = found.groupBy("doc_id", "token").agg(F.max(F.struct("decoded", "root_end")).alias("m"))
    return best.select("doc_id", "token", "m.decoded", "m.root_end")


@query(f"WITH {PLANTED} SELECT doc_id, sha256(token) AS norm_hash FROM p")
def norm_hash(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", F.sha2("token", 256).alias("norm_hash"))


@query("SELECT sha256(text) AS norm_hash, count(*) AS objects, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_across_files(spark, sf_dir):
    return _text(spark, sf_dir).groupBy(F.sha2("text", 256).alias("norm_hash")).agg(F.count(F.lit(1)).alias("objects"), F.min("doc_id").alias("first_doc")).where("objects > 1")


_PATHS = "CASE doc_id % 6 WHEN 0 THEN 'src/main.rs' WHEN 1 THEN 'Tests/a.PY' WHEN 2 THEN 'vendor/x/logo.png' WHEN 3 THEN 'build/.env' WHEN 4 THEN 'docs/readme' ELSE 'a/fixtures/data.tar.gz' END"


def _list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(f"""WITH p AS (SELECT doc_id, lower({_PATHS}) AS path FROM documents), x AS (SELECT doc_id, string_split(path, '/') AS s, regexp_extract(path, '[^/]\\.([^./]*)$', 1) AS e FROM p),
b AS (SELECT doc_id, CASE WHEN list_has_any(s, {_list(gates.TEST_SEGMENTS)}) THEN 2 ELSE 0 END + CASE WHEN list_has_any(s, {_list(gates.VENDOR_SEGMENTS)}) THEN 4 ELSE 0 END + CASE WHEN list_has_any(s, {_list(gates.GENERATED_SEGMENTS)}) THEN 8 ELSE 0 END
 + CASE WHEN list_contains({_list(gates.SOURCE_EXTENSIONS)}, e) THEN 1 ELSE 0 END + CASE WHEN list_contains({_list(gates.BINARY_EXTENSIONS)}, e) THEN 16 ELSE 0 END AS c FROM x)
SELECT doc_id, (CASE WHEN c = 0 THEN 32 ELSE c END)::INTEGER AS class FROM b""")
def path_class(spark, sf_dir):
    return _text(spark, sf_dir).select("doc_id", F.expr(_PATHS).alias("path")).select("doc_id", gates.path_class(F.col("path")).alias("class"))


@query(f"WITH p AS (SELECT doc_id, {_PATHS} AS path FROM documents) SELECT doc_id, path FROM p WHERE NOT list_contains({_list(gates.BINARY_EXTENSIONS)}, regexp_extract(lower(path), '[^/]\\.([^./]*)$', 1))")
def path_exclude(spark, sf_dir):
    paths = _text(spark, sf_dir).select("doc_id", F.expr(_PATHS).alias("path"))
    return paths.where(~gates.excluded(F.col("path"), 2))


@query("SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 OR length(text) < 0")
def binary_skip(spark, sf_dir):
    """O-binary-skip: objects without a NUL in their first 8 KiB; every seventh gets one planted."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("\0"), F.col("text"))).otherwise(F.col("text"))
    return _text(spark, sf_dir).where(~gates.likely_binary(gates.latin1(text))).select("doc_id")


_NAMES = "url || CASE page_id % 5 WHEN 0 THEN '.TAR.GZ' WHEN 1 THEN '.zip' WHEN 2 THEN '.gz' WHEN 3 THEN '.tgz' ELSE '.txt' END"


@query(f"""SELECT page_id, CASE WHEN regexp_matches(n, '\\.(tar\\.gz|tgz)$') THEN 'targz' WHEN n LIKE '%.tar' THEN 'tar' WHEN n LIKE '%.gz' THEN 'gzip' WHEN n LIKE '%.zip' THEN 'zip' END AS kind FROM (SELECT page_id, lower({_NAMES}) AS n FROM pages)""")
def archive_kind(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", gates.archive_kind(F.expr(_NAMES)).alias("kind"))


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("child"), F.expr("o_orderkey div 2").alias("parent")).distinct()


_EDGES = "e AS (SELECT DISTINCT o_orderkey AS child, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey > 0)"


@query(f"""WITH RECURSIVE {_EDGES}, t AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 100 = 99 UNION SELECT parent FROM t JOIN e ON t.id = e.child),
w AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 1000 = 499 UNION SELECT parent FROM w JOIN e ON w.id = e.child) SELECT id FROM t EXCEPT SELECT id FROM w""")
def commit_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    pick = lambda condition: orders.where(condition).select(F.col("o_orderkey").alias("id"))
    return history.commit_range(pick("o_orderkey % 100 = 99"), pick("o_orderkey % 1000 = 499"), history.materialise(_edges(spark, sf_dir), "edges"))


@query(f"""WITH RECURSIVE {_EDGES}, n AS (SELECT DISTINCT o_orderkey AS id FROM orders), g AS (SELECT id, 1::BIGINT AS generation FROM n WHERE id NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, g.generation + 1 FROM g JOIN e ON e.parent = g.id) SELECT id, generation FROM g""")
def generation_number(spark, sf_dir):
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).distinct()
    return history.generations(commits, history.materialise(_edges(spark, sf_dir), "edges"))


_TREE = "t AS (SELECT l_orderkey AS tree, l_linenumber AS name, min(l_partkey) AS oid FROM lineitem GROUP BY ALL)"


def _diffs(spark, sf_dir, parents, merge_mode="all_parents"):
    """The changes of each tree against those numbered ``parents`` before it, as commits of that number."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tree"), F.col("l_linenumber").alias("name")).agg(F.min("l_partkey").alias("oid"))
    entries = history.materialise(t.select("tree", F.col("name").cast("string").alias("name"), "oid", F.lit("file").alias("kind"), F.lit("100644").alias("mode")), "trees")
    graph = entries.select(F.col("tree").alias("id"), "tree", F.array(*[F.col("tree") - k for k in parents]).alias("parents")).distinct()
    found = history.candidates(graph.select("id"), graph, entries, merge_mode)
    return found.select(F.col("commit_id").alias("tree"), F.col("path").cast("int").alias("name"), "oid", F.col("parent_idx").cast("long").alias("parent_idx"), "change")


@query(f"WITH {_TREE} SELECT n.tree, n.name, n.oid, CASE WHEN o.oid IS NULL THEN 'Add' ELSE 'Modify' END AS change FROM t n LEFT JOIN t o ON o.tree = n.tree - 1 AND o.name = n.name WHERE o.oid IS NULL OR o.oid <> n.oid")
def tree_diff(spark, sf_dir):
    return _diffs(spark, sf_dir, (1,)).drop("parent_idx")


_PARENTS = "c AS (SELECT tree, name, oid, unnest([0, 1]) AS parent_idx FROM t)"


@query(f"WITH {_TREE}, {_PARENTS} SELECT c.tree, c.name, c.oid, c.parent_idx::BIGINT AS parent_idx FROM c LEFT JOIN t o ON o.tree = c.tree - 1 - c.parent_idx AND o.name = c.name WHERE o.oid IS NULL OR o.oid <> c.oid")
def merge_parents(spark, sf_dir):
    return _diffs(spark, sf_dir, (1, 2)).drop("change")


@query(f"WITH {_TREE} SELECT c.tree, c.name, c.oid, 0::BIGINT AS parent_idx FROM t c LEFT JOIN t o ON o.tree = c.tree - 1 AND o.name = c.name WHERE o.oid IS NULL OR o.oid <> c.oid")
def first_parent(spark, sf_dir):
    return _diffs(spark, sf_dir, (1, 2), "first_parent").drop("change")


@query("SELECT l_partkey AS oid, l_orderkey AS commit_id, l_linenumber AS path FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def canonical_ctx(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("oid"), F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").alias("path"))
    return relational.canonical_context(c, "oid", ["commit_id", "path"])


@query("SELECT DISTINCT l_partkey AS oid FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def seen_anti_join(spark, sf_dir):
    candidates = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("oid")).distinct()
    return history.unseen(candidates, table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("oid")))


@query("SELECT n_name AS ref, n_nationkey AS tip, r_regionkey AS watermark FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def watermark_left_join(spark, sf_dir):
    refs, marks = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_regionkey < 3")
    return refs.join(marks, refs.n_regionkey == marks.r_regionkey, "left").select(F.col("n_name").alias("ref"), F.col("n_nationkey").alias("tip"), F.col("r_regionkey").alias("watermark"))


@query("SELECT l_partkey AS oid, min(l_orderkey) AS topo, arg_min(l_linenumber, l_orderkey * 100 + l_linenumber) AS path FROM lineitem GROUP BY 1")
def first_intro(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("oid"), F.col("l_orderkey").alias("topo"), F.col("l_linenumber").alias("path"))
    return history.first_introduction(a)


@query("SELECT DISTINCT l_partkey AS oid, l_orderkey AS commit_id, l_linenumber AS path FROM lineitem")
def run_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("oid"), F.col("l_orderkey").alias("commit_id"), F.col("l_linenumber").alias("path"))
    return relational.merge_sorted_runs([rows.where("path % 2 = 0"), rows.where("path % 2 = 1")])


@query("""WITH o AS (SELECT l_partkey AS oid, count(DISTINCT l_suppkey) AS f FROM lineitem GROUP BY 1) SELECT 'blob_ctx' AS namespace, count(*) AS n FROM o UNION ALL SELECT 'finding', sum(f)::BIGINT FROM o UNION ALL SELECT 'seen_blob', count(*) FROM o""")
def finalize_counts(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.count(F.lit(1)).alias("f"))
    sums = o.agg(F.count(F.lit(1)).alias("blobs"), F.sum("f").alias("found"))
    return sums.selectExpr("stack(3, 'blob_ctx', blobs, 'finding', found, 'seen_blob', blobs) as (namespace, n)")


@query("SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1")
def skip_reason_hist(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN value < 1 THEN 0 ELSE floor(log2(floor(value)))::BIGINT + 1 END AS bucket, count(*) AS n FROM events GROUP BY 1")
def log2_hist(spark, sf_dir):
    return relational.log2_histogram(table(spark, sf_dir, "events"), "value")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def p50_p95(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_type AS reason, event_id, left(props, 192) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 32")
def sample_ring(spark, sf_dir):
    """O-sample-ring: at most 32 samples of a reason; the limit is the feature, and each task keeps 32 before the shuffle."""
    kept = relational.keep_first(table(spark, sf_dir, "events"), ["event_type"], [F.col("event_id")], 32)
    return kept.select(F.col("event_type").alias("reason"), "event_id", F.left("props", F.lit(192)).alias("sample"))


@query(f"WITH {PLANTED} SELECT 'summary' AS type, count(*) AS objects, sum(octet_length(encode(text)))::BIGINT AS bytes, count_if(contains(text, token)) AS findings FROM p")
def summary_event(spark, sf_dir):
    return planted(spark, sf_dir).agg(F.count(F.lit(1)).alias("objects"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.expr("contains(text, token)")).alias("findings")).select(F.lit("summary").alias("type"), "objects", "bytes", "findings")


@query("SELECT l_partkey AS pack_id, l_orderkey AS pack_offset, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS place FROM lineitem")
def pack_order(spark, sf_dir):
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pack_id"), F.col("l_orderkey").alias("pack_offset"), F.row_number().over(order).cast("long").alias("place"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS tree, 'n' || (l_linenumber // 2)::VARCHAR || CASE l_linenumber % 2 WHEN 0 THEN '' ELSE '.c' END AS name, CASE l_linenumber % 2 WHEN 0 THEN 'tree' ELSE 'file' END AS kind FROM lineitem)
SELECT tree, name, row_number() OVER (PARTITION BY tree ORDER BY CASE kind WHEN 'tree' THEN name || '/' ELSE name END) AS place FROM e""")
def tree_order(spark, sf_dir):
    odd = F.col("l_linenumber") % 2 == 1
    name = F.concat(F.lit("n"), F.expr("cast(l_linenumber div 2 as string)"), F.when(odd, ".c").otherwise(""))
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree"), name.alias("name"), F.when(odd, "file").otherwise("tree").alias("kind")).distinct()
    place = F.row_number().over(Window.partitionBy("tree").orderBy(history.tree_order(F.col("name"), F.col("kind"))))
    return entries.select("tree", "name", place.cast("long").alias("place"))


@query("SELECT s_suppkey, n_name AS rule FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def rule_name_join(spark, sf_dir):
    """The equi join of findings with rule names: a fixed table of 25 rows."""
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("rule"))


@query("SELECT c_custkey, o_orderkey AS oid, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM customer JOIN orders ON c_custkey = o_custkey QUALIFY place <= 3")
def top_objects(spark, sf_dir):
    both = table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    order = Window.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return both.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 3").select("c_custkey", F.col("o_orderkey").alias("oid"), "place")


@query()
def scan_documents(spark, sf_dir):
    """The whole scan with all built-in rules, windows, decoding and provenance."""
    from tarn.operators.scan import scan

    return scan(_text(spark, sf_dir), id_col="doc_id", content_col="text").select("object_id", "rule_id", "rule", "variant", "span_start", "span_end", "root_start", "root_end", "norm_hash")


@query()
def scan_pages(spark, sf_dir):
    from tarn.operators.scan import scan

    return scan(table(spark, sf_dir, "pages"), id_col="page_id", content_col="html").select("object_id", "rule_id", "rule", "variant", "root_start", "root_end", "norm_hash")


@query()
def scan_planted_encoded(spark, sf_dir):
    """Planted tokens behind URL escapes, base64 and UTF-16, found by the Arrow scan."""
    from tarn.operators.scan import scan

    p = planted(spark, sf_dir)
    url = F.concat(F.lit("q="), F.replace("token", F.lit("_"), F.lit("%5F")), F.lit(" ")).cast("binary")
    wide = F.encode(F.concat(F.lit("key "), "token"), "UTF-16LE")
    content = F.when(F.col("doc_id") % 3 == 0, url).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x ").cast("binary"), F.base64(F.concat(F.lit("pad "), "token")).cast("binary"))).otherwise(wide)
    return scan(p.select("doc_id", content.alias("content")), id_col="doc_id").select("object_id", "rule", "variant", "root_start", "root_end", "norm_hash")


@query()
def jsonl_render(spark, sf_dir):
    from tarn.sources.events import finding_events

    found = scan_documents(spark, sf_dir)
    return finding_events(found, source="fs")
