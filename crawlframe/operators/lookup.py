"""Point lookups on keyed tables: sorted files whose row-group statistics, and optional bloom filters, prune a read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlframe.sources.store import Files


def write_sorted(df: DataFrame, path: str, key: str = "url", mode: str = "overwrite", bloom: bool = True) -> None:
    """Files of disjoint key ranges, each sorted by key."""
    writer = df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).option("compression", "zstd")
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)


def write_hashed(df: DataFrame, path: str, parts: int, key: str = "url", mode: str = "overwrite") -> None:
    """Files dealt by a hash of the key, in folders that :func:`get_hashed` prunes to one."""
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    df.withColumn("part", part).repartition(parts, "part").sortWithinPartitions(key).write.mode(mode).partitionBy("part").parquet(path)


def get(df: DataFrame, value, key: str = "url") -> DataFrame:
    """Rows of a key, by a filter that reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


def get_hashed(spark: SparkSession, path: str, value: str, parts: int, key: str = "url") -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter((F.col("part") == F.pmod(F.xxhash64(F.lit(value)), F.lit(parts)).cast("int")) & (F.col(key) == F.lit(value))).drop("part")


def mid_key(df: DataFrame, interval: int = 128, key: str = "url") -> DataFrame:
    """The middle entry of an index with every ``interval``-th key; no row if there are no keys.

    Its rank is known from the count. Counts of keys by prefix lead to the one prefix that holds it, four characters
    at a time, so only the keys of that prefix are ever sorted.
    """
    keys = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"))
    total = keys.count()
    rank = ((total + interval - 1) // interval - 1) // 2 * interval
    depth = 0
    while total > 100_000:
        depth += 4
        counts = keys.groupBy(F.substring("k", 1, depth).alias("p")).agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))
        before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("b", F.coalesce(F.sum("n").over(before), F.lit(0)))
        hit = placed.filter((F.col("b") <= rank) & (F.col("b") + F.col("n") > rank)).first()
        keys, rank, total = keys.filter(F.substring("k", 1, depth) == hit["p"]), rank - hit["b"], hit["n"]
        if hit["least"] == hit["most"]:
            return keys.select(F.col("k").alias("mid_key")).limit(1)
    number = F.row_number().over(Window.orderBy("k")) - 1
    return keys.withColumn("_n", number).filter(F.col("_n") == max(rank, 0)).select(F.col("k").alias("mid_key"))


def size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("size"))


def final_key(df: DataFrame, key: str = "url") -> DataFrame:
    return df.agg(F.max(key).alias("final_key"))


def index_entries(spark: SparkSession, path: str, key: str = "url", kind: str = "string") -> DataFrame:
    """(file, first_key, last_key, entries, out_of_order) of each file of a keyed table; files that can't be read are left out.

    A key is out of order if it is less than that of the row before; equal keys are in order. Rows are compared in blocks
    of 65,536, and then the ends of blocks, so a file of any length is no task of its own. ``kind`` is the type of the key.
    """
    rows = spark.read.schema(f"`{key}` {kind}").option("ignoreCorruptFiles", True).parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_i"), F.col(key).alias("_k"))
    rows = rows.withColumn("_block", F.shiftright("_i", 16))
    less = (F.lag("_k").over(Window.partitionBy("file", "_block").orderBy("_i")) > F.col("_k")).alias("_less")
    blocks = rows.select("*", less).groupBy("file", "_block").agg(
        F.min_by("_k", "_i").alias("_first"), F.max_by("_k", "_i").alias("_last"), F.min("_k").alias("_least"), F.max("_k").alias("_most"), F.count("*").alias("_n"), F.count_if("_less").alias("_bad"),
    )
    ends = (F.lag("_last").over(Window.partitionBy("file").orderBy("_block")) > F.col("_first")).alias("_less")
    return blocks.select("*", ends).groupBy("file").agg(
        F.min("_least").alias("first_key"), F.max("_most").alias("last_key"), F.sum("_n").alias("entries"), (F.sum("_bad") + F.count_if("_less")).alias("out_of_order"),
    )


def repair_index(spark: SparkSession, path: str, key: str = "url", dry_run: bool = False) -> int:
    """Build the index of a keyed table where it has none, at ``<path>_index``; the number of entries that can be read.

    -1 where there is an index already. A table that is not there is an error; a dry run writes nothing.
    """
    files = Files(spark)
    if not files.exists(path):
        raise FileNotFoundError(path)
    if files.exists(f"{path}_index/_SUCCESS"):
        return -1
    found = index_entries(spark, path, key)
    if not dry_run:
        found.coalesce(1).write.mode("overwrite").parquet(f"{path}_index")
        found = spark.read.parquet(f"{path}_index")
    return found.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]


def check_order(spark: SparkSession, path: str, key: str = "url") -> None:
    """ValueError if a key of the table stands after a greater one in its file."""
    bad = index_entries(spark, path, key).filter("out_of_order > 0").first()
    if bad is not None:
        raise ValueError(f"key out of order in {bad['file']}: {bad['out_of_order']} times")


def get_indexed(spark: SparkSession, path: str, value: str, key: str = "url") -> DataFrame:
    """Rows of a key, from the files whose range of keys in the index holds it; other files aren't opened."""
    near = spark.read.parquet(f"{path}_index").filter(F.lit(value).between(F.col("first_key"), F.col("last_key")))
    names = [r["file"] for r in near.select("file").collect()]  # files with disjoint ranges: those that meet at the key
    schema = spark.read.parquet(path).schema
    return get(spark.read.schema(schema).parquet(*names), value, key) if names else spark.createDataFrame([], schema)


def last_values(df: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """The row that was put last for each key, as a file with an entry for every record answers."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_v")).select(key, "_v.*")


def hash_facts(df: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """(size, final_key): different keys, and the key that was put last."""
    return df.agg(F.count_distinct(key).alias("size"), F.max_by(key, F.col(order)).alias("final_key"))


def text_record(df: DataFrame, number: int, key: str = "url") -> DataFrame:
    """The record of a number, from 0, in the order of keys of each segment; tasks hand on the ``number`` + 1 first rows of each."""
    place = F.row_number().over(Window.partitionBy("segment").orderBy(key))
    return df.withColumn("_n", place).filter(F.col("_n") <= number + 1).filter(F.col("_n") == number + 1).drop("_n")


def parse_text(df: DataFrame, version: int = 1) -> DataFrame:
    """Text records of parsed pages: (url, segment, version, text); a null text is an empty record."""
    return df.select("url", "segment", F.lit(version).cast("int").alias("version"), F.coalesce("text", F.lit("")).alias("text"))


def read_parse_text(records: DataFrame, version: int = 1) -> DataFrame:
    """The records of a version; a record of another version is an error, as its fields may mean something else."""
    wrong = F.raise_error(F.concat(F.lit("version of a text record: "), F.coalesce(F.col("version").cast("string"), F.lit("none")))).cast("string")
    return records.withColumn("text", F.when(F.col("version").eqNullSafe(version), F.col("text")).otherwise(wrong))
