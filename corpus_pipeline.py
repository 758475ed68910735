"""A training corpus from ``documents`` in five stages, each written as Parquet and read again by the next.

Language ID drops documents without letters and those of which no language holds
``LEAST`` of the letters, as junk and lists do; near-duplicate detection keeps the first
document of each group; decontamination drops documents that contain benchmark items;
the secret scan masks the secrets it finds; packing cuts what is left into token
sequences. The columns of documents stay until the last stage.

Defined results: every stage decides by the row, whatever its id. A row with a null id
or an id that other rows have too is a document of its own, known by its content, and
comes behind those with an id of their own in a group; rows that are equal in all
columns are one document. A null or empty text has no letters and goes first. Without
any labelled row there is no model, and all documents with letters stay. Ties in a group
go to the smallest id. Texts are read whole, however long. Empty tables give empty
tables; other columns than those of documents are left behind, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontaminate, langid, neardup, packing, queries, secrets
from tarn.llm._common import MOST_IDS, drop_path, materialise, only, scratch, table
from tarn.llm.spans import MARK

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: The share of its letters that a document's language must have.
LEAST = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told."""
    told = langid.identify(docs.select(*COLUMNS), keep=COLUMNS)
    unknown = F.col("lang_pred") == langid.UNKNOWN
    kept = told.where(F.col("text").rlike(r"\p{L}") & (unknown | (F.col("score") >= LEAST)))
    return kept.select("doc_id", "text", "row.lang", "row.source", "row.n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``key``: their id or, where it isn't theirs alone (``odd``), a number of 2^62 and more from all columns."""
    shared = materialise(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("shared")), "shared")
    few = shared.limit(MOST_IDS + 1).count() <= MOST_IDS
    both = docs.join(F.broadcast(shared) if few else shared, "doc_id", "left")
    odd = F.col("doc_id").isNull() | F.col("shared").isNotNull()
    content = F.xxhash64("doc_id", "text", "lang", "source", "n_chars").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    return both.select(*COLUMNS, odd.alias("odd"), F.when(odd, content).otherwise(F.col("doc_id")).alias("key"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words are similar to 0.8 or more: that of the smallest id."""
    keyed = _keyed(docs.select(*COLUMNS))
    found = neardup.near_duplicates(keyed, id_col="key", words=5, similarity=0.8)
    gone = materialise(found.where(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct(), "gone")
    once = only(keyed, gone, "key", "left_anti")
    return once.where(~F.col("odd")).select(*COLUMNS).unionAll(once.where("odd").dropDuplicates(["key"]).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by its kind in brackets."""
    # Masks are set in the row that was scanned; ``odd`` is the text where the scan reads another one.
    odd = F.when(F.col("text").isNull() | F.contains("text", F.lit(MARK)), F.struct("text")).alias("odd")
    scanned = secrets.scan(docs.select(*COLUMNS, odd), keep=("lang", "source", "n_chars", "odd"))
    own = F.when(F.col("row.odd").isNotNull(), F.col("row.odd.text")).otherwise(F.col("text"))
    scanned = scanned.select("doc_id", own.alias("text"), "found", "row.lang", "row.source", "row.n_chars")
    new = scanned.withColumn("new", F.when(F.size("found") > 0, secrets.masked("text", "found")))
    out = new.withColumn("text", F.coalesce("new", "text"))
    return out.withColumn("n_chars", F.when(F.col("new").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 tokens."""
    return packing.pack(docs, queries.tokenizer_file())


STAGES = [("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("secret scan", secret_masks), ("packing", pack)]

#: The models and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last is not None:
            drop_path(spark, last)
        last = path
    return docs
