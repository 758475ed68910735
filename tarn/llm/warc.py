"""A content-addressed archive of web records.

Two tables: ``payloads`` holds each distinct payload once under its SHA-256, and
``headers`` holds every record's exact header block with its payload's address. The
original records are a join of the two. A digest counts as verified: on writing,
equal addresses must agree in length and SHA-1 as well, and on reading each stored
payload is hashed again.

The record of the largest id among equal payloads is the response, which the others
revisit; payloads below ``least`` bytes are stored like all but never revisited.

Defined results: a null payload is an empty one; a null url is written without a
target; rows that share an id are records of their own (the first of them by url is
the response when they carry the largest id); a record with a null id is a response
if no other has its payload; rows that are equal in id, url and payload, the largest id
among them, are one response record, repeated; header fields end at line ends, so
line ends in urls are percent-encoded; other columns are left out, whatever their names;
empty tables give empty archives; payloads of any length are stored whole.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm._common import materialise, scratch

DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: 5 of them are 4 of base 32."""
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]), DIGITS, BASE32)


def _bytes(x: Column) -> Column:
    return F.coalesce(F.encode(x.cast("string"), "UTF-8"), F.lit(b""))


#: Fixed value: what a revisit record shares with the one it refers to.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(kind: Column, r: str, date: str) -> Column:
    """The exact bytes before a record's block, as text. A response is named by its page, url and payload, a revisit at random."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace(f"{r}.url", "\r", "%0D"), "\n", "%0A")
    uid = lambda page, tail: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), tail, F.lit(">"))
    response = lambda page, url: uid(page, F.md5(F.concat_ws("\n", F.coalesce(url, F.lit("")), "digest")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(kind == "revisit", uid(F.col(f"{r}.page_id"), F.uuid())).otherwise(response(F.col(f"{r}.page_id"), F.col(f"{r}.url")))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.when(kind == "revisit", F.concat(line("WARC-Refers-To", response(F.col("response_id"), F.col("response_url"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col(f"{r}.sha1")))),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(F.col(f"{r}.size").cast("string"))),
        F.lit("\r\n"),
    )


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str | None = None) -> None:
    """Write the archive of ``pages`` to ``path``; ``date`` is that of the records, now if it isn't given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = _bytes(pages[payload_col])
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("size"))
    groups = keyed.groupBy("digest").agg(
        F.max("page_id").alias("response_id"), F.max_by(F.coalesce("url", F.lit("")), F.struct(F.col("page_id").isNotNull(), "page_id", F.coalesce("url", F.lit("")))).alias("response_url"),
        F.max("size").alias("size"), F.max("sha1").alias("sha1"), (F.max("size") == F.min("size")).alias("a"), (F.max("sha1") == F.min("sha1")).alias("b"),
    )
    # Written out, so that the joins below have a shuffle on either side and Spark can split a frequent payload's rows.
    verified = materialise(groups.withColumn("response_id", F.when(F.col("a") & F.col("b"), F.col("response_id")).otherwise(F.raise_error("one digest for two payloads").cast("long"))), "groups")
    k, g = keyed.alias("k"), verified.alias("g")
    both = k.join(g, "digest")
    is_response = (F.col("k.size") < least) | (F.col("k.page_id").eqNullSafe(F.col("g.response_id")) & (F.coalesce("k.url", F.lit("")) == F.col("g.response_url")))
    kind = F.when(is_response, "response").otherwise("revisit")
    both.select(F.col("k.page_id").alias("page_id"), "digest", _header(kind, "k", date).alias("header")).write.parquet(f"{path}/headers")
    # The holders' rows alone keep their bytes. They are dealt by all of the key, which the removal of repeated rows needs too, so payloads move once.
    name = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("null"))
    key = ["digest", "page_key", "url_key"]
    holders = verified.select("digest", name("response_id").alias("page_key"), F.col("response_url").alias("url_key"))
    full = rows.select(F.sha2("payload", 256).alias("digest"), name("page_id").alias("page_key"), F.coalesce("url", F.lit("")).alias("url_key"), "payload")
    kept = full.join(holders, key, "left_semi").dropDuplicates(key)
    kept.select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload), verified: a payload that doesn't hash to its address is an error."""
    p = spark.read.parquet(f"{path}/payloads")
    return p.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error("a payload isn't what its address says").cast("binary")).alias("payload"))


def field(name: str) -> Column:
    """A field of the header block; null if it has none."""
    value = F.regexp_extract("header", rf"\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload): the records with their payloads; a revisit has that of the record it refers to."""
    return spark.read.parquet(f"{path}/headers").join(payloads(spark, path), "digest").select("page_id", "header", "payload")


def raw(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the exact bytes of each record of the archive."""
    block = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records(spark, path).select("page_id", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"))


def parse(raw_records: DataFrame, record_col: str = "record") -> DataFrame:
    """Other columns, header and block of records given as bytes: the way back from ``raw``."""
    at = F.instr(F.decode(record_col, "ISO-8859-1"), "\r\n\r\n") + 3
    return raw_records.select(*[c for c in raw_records.columns if c != record_col], F.decode(F.substring(F.col(record_col), F.lit(1), at), "UTF-8").alias("header"), F.substring(F.col(record_col), at + 1, F.length(record_col) - at - 4).alias("block"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each record, with length and digest of the payload that was read back."""
    facts = payloads(spark, path).select("digest", F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    told = spark.read.parquet(f"{path}/headers").select("page_id", "digest", field("WARC-Type").alias("record_type"), F.regexp_extract(field("WARC-Refers-To"), ":page:(-?[0-9]+):", 1).cast("long").alias("refers_to"))
    return told.join(facts, "digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_path(spark: SparkSession) -> str:
    return scratch(spark, "warc")
