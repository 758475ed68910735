"""The thin ``opN_*`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm._common import table


def tokenizer_file() -> str:
    """The public word-level byte-pair tokenizer with 49,408 ids."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import pii

    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import warc

    path = warc.archive_path(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.report(spark, path)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import secrets

    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import sharding
    from tarn.llm._common import scratch

    store = sharding.shard_documents(table(spark, sf_dir, "documents"), scratch(spark, "store"))
    return store.read().select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm import urls

    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS k FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS h FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * c >= 80 * (m.n + o.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, q.c AS component_id, w.doc_id = q.c AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) q ON q.doc_id = w.doc_id
"""

OP8_SQL = "SELECT doc_id, lang, source, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"

QUERIES = {f.__name__: f for f in (op1_pii, op2_top_k, op3_packing, op4_warc, op5_decontaminate, op6_near_duplicates, op7_secrets, op8_sharding, op9_language, op10_urls)}
ORACLES: dict[str, str] = {"op2_top_k": OP2_SQL, "op4_warc": OP4_SQL, "op6_near_duplicates": OP6_SQL, "op8_sharding": OP8_SQL}
