"""Pipeline of training-data operators over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before it
kept. Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm import bpe, decontam, langid, linededup, neardup
from crawlframe.llm.common import Workspace, table
from crawlframe.llm.queries import BPE_RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL can express neither the trained classifier nor the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier doesn't reject."""
    return langid.keep(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; one that held nothing else goes as a whole."""
    found = linededup.dedup(docs)
    left = found.filter("n_removed = 0 or n_removed < n_lines")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles, at a similarity of 0.8 or more, hold together."""
    return neardup.keep_one(docs, neardup.Rule(words=5, percent=80)).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, decoded again for a round trip."""
    return bpe.digests(docs, BPE_RANKS)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
