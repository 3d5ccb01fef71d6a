"""Content-addressed web archive (operator 1).

An archive is two tables in one folder. ``payloads`` holds each different payload once, under
its SHA-256 digest and length; ``headers`` holds, for every record, the exact bytes of the WARC header block
and the digest that leads to its payload. Original records come back by joining the two, and every payload
that is read is hashed again, so a damaged one is never handed out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm.common import Workspace, only

CRLF = "\r\n"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are four times 40 bits, each eight signs."""
    digest = F.sha1(payload)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0"), _DIGITS32, _BASE32) for k in range(4)])


def _one_line(value: Column) -> Column:
    """A header value can't hold line ends; they are percent-encoded."""
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write(pages: DataFrame, target: str, min_revisit_bytes: int = 0, date: str = WARC_DATE) -> None:
    """Write one record for each row of ``pages`` (page_id, url, html) to the archive folder ``target``.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of ``min_revisit_bytes``
    or more, those with the smallest page_id are responses and the others revisit it; smaller payloads
    are responses always. Rows that repeat a page_id and its payload get the same type. A null page_id
    comes after all others; where a payload has no other page_id, its records are all
    responses. A null url is an empty target. An empty table makes an empty archive.
    """
    rows = only(pages, "page_id", "url", "html").withColumn("payload", F.coalesce(F.col("html").cast("binary"), F.lit(b""))).drop("html")
    rows = rows.select("*", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("length"))
    stored = rows.groupBy("sha256", "length").agg(F.min("page_id").alias("first_id"), F.first("payload").alias("payload"))
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/payloads")
    first = rows.sparkSession.read.schema(stored.schema).parquet(f"{target}/payloads").drop("payload")
    marks = rows.select("page_id", "url", "sha256", "length", base32_sha1(F.col("payload")).alias("sha1")).join(first, ["sha256", "length"])
    own = F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("length") < min_revisit_bytes)
    kind = F.when(own, "response").otherwise("revisit")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(~own, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_id")))),
        F.when(~own, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(own, F.col("length")).otherwise(0).cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)).cast("binary")
    marks.select("page_id", header.alias("header"), "sha256", "length").write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/headers")


def payloads(spark: SparkSession, source: str) -> DataFrame:
    """(sha256, length, payload, sound): stored payloads, hashed again as they are read."""
    stored = spark.read.parquet(f"{source}/payloads").drop("first_id")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("length"))
    return stored.withColumn("sound", sound)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _checked(value: Column) -> Column:
    return F.when(F.col("sound"), value).otherwise(F.raise_error(F.concat(F.lit("payload is damaged or missing: "), F.col("sha256"))))


def records(spark: SparkSession, source: str) -> DataFrame:
    """(page_id, record): original records as bytes, header, block and closing line ends."""
    found = spark.read.parquet(f"{source}/headers").join(payloads(spark, source), ["sha256", "length"], "left")
    block = F.when(_field("WARC-Type") == "response", _checked(F.col("payload"))).otherwise(F.lit(b""))
    return found.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def export(spark: SparkSession, source: str, target: str) -> None:
    """Plain WARC files: records one after the other, written by Spark's own writer to any file system.

    The writer puts a line feed after each value, and it is the last byte of the record.
    """
    record = records(spark, source).select(F.expr("cast(substring(record, 1, octet_length(record) - 1) as string)").alias("value"))
    record.write.mode("overwrite").option("lineSep", "\n").text(target)


def parse(data: bytes):
    """(header, block) of each record of a WARC file's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        size = next(int(x.split(b":")[1]) for x in data[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield data[at:end], data[end : end + size]
        at = end + size + 4


def read_files(spark: SparkSession, source: str) -> DataFrame:
    """(header binary, block binary) of each record of exported files."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(list(parse(content)), columns=["header", "block"])

    return spark.read.format("binaryFile").load(f"{source}/part-*").select("content").mapInPandas(run, "header binary, block binary")


def report(spark: SparkSession, source: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, from the archive.

    Stored payloads are verified and hashed where they are read; only their digests meet the headers.
    """
    facts = payloads(spark, source).select("sha256", "length", "sound", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    found = spark.read.parquet(f"{source}/headers").join(facts, ["sha256", "length"], "left")
    stated = F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")
    refers = F.regexp_extract(F.coalesce(_field("WARC-Refers-To"), F.lit("")), r"^<urn:page:(-?\d+)>$", 1)
    return found.select(
        "page_id",
        _checked(F.col("size")).alias("payload_bytes"),
        F.when(stated == F.col("sha1"), stated).otherwise(F.raise_error(F.lit("header and payload digests differ"))).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        F.nullif(refers, F.lit("")).cast("long").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in a workspace and report on what the archive holds."""
    work = Workspace(pages.sparkSession, "warc")
    write(pages, work.path("archive"))
    return report(pages.sparkSession, work.path("archive"))
