"""Queries over the training-data operators, with production parameters and over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm import ann, bpe, counts, decontam, langid, linededup, neardup, pii, tokenfiles, warc
from crawlframe.llm.common import table

TOKEN_IDS = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_COUNTS = public_tokenizers.path("piece_bpe_32k.model")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"), neardup.Rule(words=3, percent=85))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), TOKEN_IDS)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), TOKEN_COUNTS)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BPE_RANKS)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.identify(table(spark, sf_dir, "documents"))


_WARC_SQL = """
with payloads as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), digests as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as hex, sha256(payload) as strong from payloads
), firsts as (
  select *, min(page_id) over (partition by strong) as first_id,
    list_transform(range(0, 40, 5), lambda i: cast('0x' || hex[i + 1:i + 5] as bigint)) as parts
  from digests
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1]), '')), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from firsts
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_line_dedup, op3_near_dedup, op4_neighbours, op5_language_id, op6_token_files, op7_decontamination, op8_token_counts, op9_byte_bpe, op10_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _WARC_SQL, "op2_line_dedup": linededup.ORACLE, "op3_near_dedup": neardup.ORACLE, "op7_decontamination": decontam.ORACLE}
