"""Token-id files of directly addressable codes (operator 6).

Ids of many documents form a block. Level 0 holds the low eight bits of each id, and a bitmap says
which ids go on; level 1 holds the next eight bits of those only, and so on. A directory of bit counts
before every 512 bits answers rank queries, so any id is found by one byte and one rank for each level,
without decoding what stands around it.

Blocks are stored without a codec, with the least and greatest doc_id of each, so a look-up prunes files and row groups by
their statistics and addresses the bytes of a block as they are. Documents are read back in the same way: the ranks
give the places of its ids on each level.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import Workspace, only, slices
from crawlframe.llm.words import ByteTable, WordTable, encode_checked

MAGIC = b"DAC1"
STEP = 512
GROUP = 1 << 19
#: Words that the library encodes at once; an encoding takes far more memory than its ids.
WORDS = 4096
#: Bytes of text that a file holds about.
FILE_BYTES = 16 << 20
_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint32)


def pack(ids: np.ndarray) -> bytes:
    """Magic, number of ids and levels; for each level its codes, bitmap and rank directory."""
    values, levels = ids.astype(np.uint32), []
    while True:
        codes, rest = (values & np.uint32(255)).astype(np.uint8), values >> np.uint32(8)
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(_COUNTS[bitmap], np.arange(0, len(bitmap), STEP // 8)) if len(bitmap) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        levels.append(struct.pack("<III", len(codes), len(bitmap), len(ranks)) + codes.tobytes() + bitmap.tobytes() + ranks.tobytes())
        if not more.any():
            break
        values = rest[more]
    return MAGIC + struct.pack("<II", len(ids), len(levels)) + b"".join(levels)


class Codes:
    """A block that was written by :func:`pack`, addressed in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.n, count = struct.unpack_from("<II", data, 4)
        self.levels, at = [], 12
        for _ in range(count):
            a, b, c = struct.unpack_from("<III", data, at)
            at += 12
            codes = np.frombuffer(data, np.uint8, a, at)
            bitmap = np.frombuffer(data, np.uint8, b, at + a)
            ranks = np.frombuffer(data, "<u4", c, at + a + b)
            self.levels.append((codes, bitmap, ranks))
            at += a + b + 4 * c

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One id, by a rank for each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (codes, bitmap, _) in enumerate(self.levels):
            value |= int(codes[i]) << (8 * k)
            if not bitmap[i // 8] >> i % 8 & 1:
                break
            i = self._rank(k, i)
        return value

    def _rank(self, k: int, i: int) -> int:
        """How many of the first ``i`` ids of level ``k`` go on: one entry of the directory and at most 64 bytes."""
        _, bitmap, ranks = self.levels[k]
        byte, bit = divmod(i, 8)
        rest = int(_COUNTS[bitmap[byte] & ((1 << bit) - 1)]) if bit else 0
        return int(ranks[i // STEP]) + int(_COUNTS[bitmap[i // STEP * (STEP // 8) : byte]].sum()) + rest

    def slice(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to ``end``; ranks give their places on each level, and nothing else is decoded."""
        found = []
        for k, (codes, bitmap, _) in enumerate(self.levels):
            more = np.unpackbits(bitmap[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 : begin % 8 + end - begin].astype(bool)
            found.append((codes[begin:end], more))
            n = int(more.sum())
            if not n:
                break
            begin = self._rank(k, begin)
            end = begin + n
        values = np.zeros(0, np.uint32)
        for codes, more in reversed(found):
            higher = np.zeros(len(codes), np.uint32)
            higher[more] = values
            values = codes.astype(np.uint32) | higher << np.uint32(8)
        return values


class LibraryTokenizer:
    """The tokenizers library, asked once for each different word."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = WordTable(self._ids, 1_000_000)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        signs = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        tokens = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            tokens[i] = bytes(signs[c] for c in token)
        self.bytes = ByteTable(tokens)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return encode_checked(self.table, self.bytes, texts, self.exact, self.special)

    def _ids(self, words: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(words), WORDS):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(words[at : at + WORDS], add_special_tokens=False)]
        return out

    def exact(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def tokenizer(path: str) -> LibraryTokenizer:
    return LibraryTokenizer(path)


def write(docs: DataFrame, path: str, target: str, end_id: int | None = 2, block: int = 1 << 16, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of all documents to ``target``, files and blocks in ascending order of doc_id.

    Each row of the Parquet files is a block: the documents in it, the ends of their ids and the codes, with no codec over them.
    A document longer than ``block`` is a block of its own. A null text counts as empty; ``end_id`` closes every document.
    doc_ids may be of any type that can be ordered and cast to a string and back. Null doc_ids come first; rows that
    repeat a doc_id stand beside each other, in the order of a hash of their texts, and all are kept.
    The texts are dealt out by ranges of doc_id before they are encoded, so the encoder runs once; the number of
    ranges follows the bytes of all texts. Other columns are left out.
    """

    def run(batches):
        import pandas as pd

        coder, before = tokenizer(path), 0
        for pdf in batches:
            texts, keys = ["" if t is None else t for t in pdf["text"]], pdf["doc_id"].tolist()
            for a, b in slices([len(t) for t in texts], GROUP):
                rows = coder.encode(texts[a:b])
                if end_id is not None:
                    rows = [np.append(r, np.uint32(end_id)) for r in rows]
                for c, d in slices([len(r) for r in rows], block):
                    ids = np.concatenate(rows[c:d])
                    yield pd.DataFrame({"before": [before], "doc_ids": [keys[a + c : a + d]], "ends": [np.cumsum([len(r) for r in rows[c:d]])], "codes": [pack(ids)]})
                    before += len(ids)

    rows = only(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // file_bytes))
    dealt = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    blocks = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "before long, doc_ids array<string>, ends array<long>, codes binary")
    blocks = blocks.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{kind}>"))
    blocks = blocks.select(F.spark_partition_id().alias("file"), F.array_min("doc_ids").alias("least"), F.array_max("doc_ids").alias("greatest"), "*")
    blocks.write.mode("overwrite").option("compression", "none").option("parquet.enable.dictionary", "false").parquet(target)


def read(spark: SparkSession, source: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of each document, from files that :func:`write` made."""
    return _read(spark, source, "ids binary", lambda codes, a, b: (codes.slice(a, b).astype("<u4").tobytes(),))


def digests(spark: SparkSession, source: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, last_id) of each document, from the files.

    ``last_id`` is a probe of the single look-up: the last id of each document, found by ranks alone.
    """
    return _read(spark, source, "ids_crc32 long, last_id long", lambda codes, a, b: (zlib.crc32(codes.slice(a, b).astype("<u4").tobytes()), codes[b - 1] if b > a else None))


def _blocks(spark: SparkSession, source: str) -> tuple[DataFrame, str]:
    """Blocks with doc_ids as strings, and the type of doc_ids."""
    blocks = spark.read.parquet(source)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.withColumn("doc_ids", F.col("doc_ids").cast("array<string>")), kind


def _read(spark: SparkSession, source: str, columns: str, values) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for file, before, keys, ends, data in zip(pdf["file"], pdf["before"], pdf["doc_ids"], pdf["ends"], pdf["codes"]):
                codes, begins = Codes(data), np.append(0, ends[:-1])
                found = [values(codes, a, b) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pd.DataFrame({"file": file, "doc_id": keys, "place": before + begins, "n_tokens": ends - begins} | {name: [f[k] for f in found] for k, name in enumerate(names)})

    blocks, kind = _blocks(spark, source)
    files = blocks.groupBy("file").agg(F.max(F.col("before") + F.element_at("ends", -1)).alias("size"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # two numbers for each file
    files = files.select("file", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    found = blocks.select("file", "before", "doc_ids", "ends", "codes").mapInPandas(run, f"file int, doc_id string, place long, n_tokens long, {columns}")
    return found.join(files, "file").select(F.col("doc_id").cast(kind).alias("doc_id"), (F.col("start") + F.col("place")).alias("start"), "n_tokens", *names)


def tokens(spark: SparkSession, source: str, doc_id, begin: int, end: int | None = None) -> list[int]:
    """The ids from ``begin`` to ``end`` of one document (the first where a doc_id repeats), cut at its end.

    Statistics of least and greatest doc_id leave the files and row groups that may hold it; of its block only the
    bytes of these ids are looked at. KeyError for a doc_id that isn't there.
    """
    blocks, kind = _blocks(spark, source)
    key = F.lit(doc_id).cast(kind)
    at = F.array_position("doc_ids", key.cast("string"))
    row = blocks.filter((F.col("least") <= key) & (F.col("greatest") >= key)).withColumn("at", at).filter("at > 0").orderBy("file", "before").select("at", "ends", "codes").first()
    if row is None:
        raise KeyError(doc_id)
    first, last = [0, *row.ends][row["at"] - 1], row.ends[row["at"] - 1]
    stop = last if end is None else min(first + end, last)
    return Codes(bytes(row.codes)).slice(min(first + begin, stop), stop).tolist()


def token_at(spark: SparkSession, source: str, doc_id, i: int) -> int:
    """One id of one document; IndexError beyond its end."""
    found = tokens(spark, source, doc_id, i, i + 1) if i >= 0 else []
    if not found:
        raise IndexError(i)
    return found[0]


def tokens_at(asked: DataFrame, source: str) -> DataFrame:
    """(doc_id, i, token) of many places (doc_id, i); places outside their documents have a null token.

    The directory gives the block and the place in it; requests go to blocks by a join and are answered by ranks. Where a doc_id repeats,
    each of its documents answers. Repeated requests get repeated answers; a null doc_id or i gets none.
    """
    blocks, kind = _blocks(asked.sparkSession, source)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for keys, places, ats, data in zip(pdf["keys"], pdf["places"], pdf["ats"], pdf["codes"]):
                codes = Codes(data)
                yield pd.DataFrame({"doc_id": keys, "i": places, "token": pd.array([codes[at] if at >= 0 else None for at in ats.tolist()], "Int64")})

    placed = blocks.select("file", "before", F.posexplode("doc_ids").alias("nth", "doc_id"), "ends")
    first = F.when(F.col("nth") > 0, F.try_element_at("ends", F.col("nth"))).otherwise(0)
    placed = placed.select("file", "before", "doc_id", first.alias("first"), F.element_at("ends", F.col("nth") + 1).alias("last"))
    wanted = only(asked, "doc_id", "i").select(F.col("doc_id").cast(kind).cast("string").alias("doc_id"), F.col("i").cast("long").alias("i"))
    at = F.col("first") + F.col("i")
    found = wanted.filter("i is not null").join(placed, "doc_id").withColumn("at", F.when((F.col("i") >= 0) & (at < F.col("last")), at).otherwise(-1))
    load = found.groupBy("file", "before").agg(F.ceil(F.count("*") / 8192).alias("parts"))  # many requests for one block are dealt out
    dealt = found.join(load, ["file", "before"]).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "parts"))
    lists = dealt.groupBy("file", "before", "part").agg(F.collect_list("doc_id").alias("keys"), F.collect_list("i").alias("places"), F.collect_list("at").alias("ats"))
    read = lists.join(blocks.select("file", "before", "codes"), ["file", "before"]).mapInPandas(run, "doc_id string, i long, token long")
    return read.withColumn("doc_id", F.col("doc_id").cast(kind))


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the files in a workspace and return :func:`digests` of what they hold."""
    work = Workspace(docs.sparkSession, "tokens")
    write(docs, path, work.path("ids"), end_id)
    return digests(docs.sparkSession, work.path("ids"))
