"""Tables as XML files, by Spark's own reader and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def save(df: DataFrame, path: str, row: str = "row", mode: str = "errorifexists") -> None:
    """One element ``row`` for each row; null columns have no element."""
    df.write.mode(mode).format("xml").option("rowTag", row).option("encoding", "UTF-8").save(path)


def load(spark: SparkSession, path: str, schema: T.StructType | str, row: str = "row") -> DataFrame:
    """Rows of files with elements ``row``; white space in values stays, and a file that isn't well-formed is an error."""
    reader = spark.read.format("xml").schema(schema).option("rowTag", row).option("ignoreSurroundingSpaces", False).option("mode", "FAILFAST")
    return reader.load(path)
