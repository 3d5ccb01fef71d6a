"""Storage of a crawl: snapshots with a pointer, segments, a lock, and writes to several sinks.

All paths go through Hadoop's file systems, so local folders and object stores work alike. A snapshot is a new
folder; it counts once a pointer file with the next number names it. Pointers are never replaced, so whenever a job ends, the
old state or the new one is in force.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Locked(RuntimeError):
    """The lock is held, or its path is a folder."""


class Files:
    """File operations of the file system of a path."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def is_dir(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def delete(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.delete(p, True)

    def rename(self, source: str, target: str) -> None:
        fs, p = self.at(source)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"{source} can't be renamed to {target}")

    def copy(self, source: str, target: str) -> None:
        fs, p = self.at(source)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, fs, self.jvm.org.apache.hadoop.fs.Path(target), False, self.conf)

    def create(self, path: str, text: str, overwrite: bool = True) -> None:
        fs, p = self.at(path)
        out = fs.create(p, overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def make(self, path: str) -> None:
        fs, p = self.at(path)
        fs.mkdirs(p)

    def read(self, path: str) -> str:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def children(self, path: str, dirs_only: bool = False) -> list[str]:
        """Names below a folder, sorted; none where it is absent."""
        fs, p = self.at(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() or not dirs_only)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's name below the one that the driver and all executors share; RuntimeError on a cluster whose session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='crawlframe-')}"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex[:12]}"


@contextmanager
def lock(spark: SparkSession, path: str, force: bool = False, wait_s: float = 0.0) -> Iterator[None]:
    """Hold a lock file; ``force`` takes one that is held, and ``wait_s`` waits for it. It is given back however the block ends."""
    files = Files(spark)
    if files.is_dir(path):
        raise Locked(f"{path} is a folder")
    until = time.monotonic() + wait_s
    while files.exists(path) and not force:
        if time.monotonic() >= until:
            raise Locked(f"{path} is held")
        time.sleep(0.2)
    try:
        files.create(path, "", overwrite=force)
    except Exception as e:
        raise Locked(f"{path} is held") from e
    try:
        yield
    finally:
        files.delete(path)


def remove_lock(spark: SparkSession, path: str) -> bool:
    """Whether there was a lock to remove; a folder at its path is an error."""
    files = Files(spark)
    if files.is_dir(path):
        raise Locked(f"{path} is a folder")
    return files.exists(path) and files.delete(path)


def replace_dir(spark: SparkSession, current: str, replacement: str, keep_old: bool = False) -> None:
    """Put ``replacement`` where ``current`` is; what was there goes, or stays as ``<current>.old``."""
    files, old = Files(spark), f"{current}.old"
    if files.exists(current):
        files.delete(old)
        files.rename(current, old)
    files.rename(replacement, current)
    if not keep_old:
        files.delete(old)


class StateStore:
    """Snapshots of a state table below a folder; the pointer with the greatest number names the one in force."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema, self.files = spark, root.rstrip("/"), schema, Files(spark)

    def _pointers(self) -> list[str]:
        return [n for n in self.files.children(f"{self.root}/pointers") if n.isdigit()]

    def current(self) -> str | None:
        pointers = self._pointers()
        return f"{self.root}/snapshots/{self.files.read(f'{self.root}/pointers/{pointers[-1]}').strip()}" if pointers else None

    def read(self) -> DataFrame:
        """The state in force; an empty table before the first install."""
        path = self.current()
        return self.spark.createDataFrame([], self.schema) if path is None else self.spark.read.schema(self.schema).parquet(path)

    def install(self, df: DataFrame, keep: int = 1) -> str:
        """Write a snapshot, and let the pointer name it; the ``keep`` last ones stay."""
        pointers = self._pointers()
        number = f"{int(pointers[-1]) + 1 if pointers else 0:012d}"
        name = f"{number}-{uuid.uuid4().hex[:8]}"
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{self.root}/snapshots/{name}")
        if self._pointers() != pointers:
            raise Locked(f"{self.root} got another snapshot meanwhile")
        self._publish(number, name)
        old = pointers[-keep:] if keep else []
        spare = {name, *(self.files.read(f"{self.root}/pointers/{p}").strip() for p in old)}
        for p in pointers:
            if p not in old:
                self.files.delete(f"{self.root}/pointers/{p}")
        for other in self.files.children(f"{self.root}/snapshots", True):
            if other not in spare:
                self.files.delete(f"{self.root}/snapshots/{other}")
        return name

    def _publish(self, number: str, name: str) -> None:
        """Put the snapshot in force: a file that is complete gets its name at once."""
        draft = f"{self.root}/pointers/.{number}-{uuid.uuid4().hex[:8]}"
        self.files.create(draft, name)
        self.files.rename(draft, f"{self.root}/pointers/{number}")

    def lock(self, force: bool = False, wait_s: float = 0.0):
        return lock(self.spark, f"{self.root}/.locked", force, wait_s)


PARTS = ("crawl_generate", "crawl_fetch", "content", "crawl_parse", "app_info")
#: Column that names the segment of a row.
SEGMENT = "_segment"


class Segments:
    """Batches of work, each a folder with parts that several jobs write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def names(self) -> list[str]:
        return [n for n in self.files.children(self.root, True) if not n.startswith(".")]

    def path(self, segment: str, part: str) -> str:
        return f"{self.root}/{segment}/{part}"

    def write(self, df: DataFrame, segment: str, part: str, mode: str = "overwrite") -> DataFrame:
        """Write a part once and return it as it was written; other parts stay."""
        df.write.mode(mode).option("compression", "zstd").parquet(self.path(segment, part))
        return self.read(segment, part)

    def has(self, segment: str, part: str) -> bool:
        return self.files.exists(self.path(segment, part))

    def read(self, segment: str, part: str) -> DataFrame:
        return self.spark.read.parquet(self.path(segment, part))

    def mark(self, segment: str, name: str) -> None:
        self.files.create(f"{self.root}/{segment}/{name}", "")

    def marked(self, segment: str, name: str) -> bool:
        return self.files.exists(f"{self.root}/{segment}/{name}")

    def deal(self, df: DataFrame, number: str, prefix: str, part: str) -> list[str]:
        """Write a part of many segments at once, of rows with a segment's ``number``; names of the segments, in order.

        One job writes a folder for each number, and the folders are then moved to their segments, however many there are.
        """
        batch = f"{self.root}/.new-{uuid.uuid4().hex[:12]}"
        df.withColumn("_segment", F.col(number)).write.option("compression", "zstd").partitionBy("_segment").parquet(batch)
        made = []
        for n in sorted(int(c.partition("=")[2]) for c in self.files.children(batch, True) if c.startswith("_segment=")):
            made.append(f"{prefix}-{n:04d}")
            self.files.make(f"{self.root}/{made[-1]}")
            self.files.rename(f"{batch}/_segment={n}", self.path(made[-1], part))
        self.files.delete(batch)
        return made

    def gather(self, part: str, segments: list[str], schema: T.StructType | None = None) -> DataFrame:
        """A part of segments by one scan, with the name of each row's segment; the schema is that of the first one if none is given."""
        rows = self.spark.read.schema(schema or self.read(segments[0], part).schema).parquet(*[self.path(s, part) for s in segments])
        return rows.withColumn(SEGMENT, F.regexp_extract("_metadata.file_path", rf"([^/]+)/{re.escape(part)}/[^/]*$", 1))

    @contextmanager
    def draft(self, df: DataFrame) -> Iterator[DataFrame]:
        """``df`` as written once, for the length of a block."""
        path = f"{self.root}/.draft-{uuid.uuid4().hex[:12]}"
        try:
            df.write.option("compression", "zstd").parquet(path)
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            self.files.delete(path)

    def spread(self, df: DataFrame, segments: list[str], part: str, files: int = 1) -> None:
        """Write a part of segments by one job, of rows with the name of their segment, in so many files each at most.

        What a segment had of the part goes. One without rows gets an empty part, a copy of one that is written for all.
        """
        batch = f"{self.root}/.new-{uuid.uuid4().hex[:12]}"
        df.repartition(SEGMENT, F.pmod(F.xxhash64("url"), F.lit(files))).write.option("compression", "zstd").partitionBy(SEGMENT).parquet(f"{batch}/rows")
        there = set(self.files.children(f"{batch}/rows", True))
        if any(f"{SEGMENT}={s}" not in there for s in segments):
            self.spark.createDataFrame([], df.drop(SEGMENT).schema).write.option("compression", "zstd").parquet(f"{batch}/none")
        for s in segments:
            self.files.delete(self.path(s, part))
            if f"{SEGMENT}={s}" in there:
                self.files.rename(f"{batch}/rows/{SEGMENT}={s}", self.path(s, part))
            else:
                self.files.copy(f"{batch}/none", self.path(s, part))
        self.files.delete(batch)

    def inputs(self, part: str, segments: list[str] | None = None, schema: T.StructType | None = None) -> tuple[DataFrame | None, list[str]]:
        """(a part of all segments, by one scan, segments without it); with a ``schema`` no file is opened to find it."""
        names = self.names() if segments is None else segments
        there = [s for s in names if self.has(s, part)]
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read.option("mergeSchema", True)
        return reader.parquet(*[self.path(s, part) for s in there]) if there else None, [s for s in names if s not in there]


_NAME = re.compile(r"[A-Za-z0-9]+")


class Router:
    """Named sinks: rows of each kind go to a folder and format of their own."""

    def __init__(self):
        self.sinks: dict[str, tuple[str, Column, list[str]]] = {}

    def add(self, name: str, rows: Column, columns: list[str], format: str = "parquet") -> Router:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a name of letters and digits: {name}")
        if name in self.sinks:
            raise ValueError(f"defined already: {name}")
        self.sinks[name] = (format, rows, columns)
        return self

    def write(self, df: DataFrame, base: str, names: list[str] | None = None, mode: str = "append") -> None:
        """One filtered write for each sink; pass a table that is written already, so that nothing runs twice."""
        for name in self.sinks if names is None else names:
            if name not in self.sinks:
                raise ValueError(f"not defined: {name}")
            format, rows, columns = self.sinks[name]
            df.filter(rows).select(*columns).write.mode(mode).format(format).save(f"{base}/{name}")


def segment_part(path: Column) -> Column:
    """struct(segment, part) of ``…/<segment>/<folder>/part-…``; null where a path has no such form."""
    pattern = r"([^/]+)/[^/]+/(part-[^/]+)/?[^/]*$"
    found = F.struct(F.regexp_extract(path, pattern, 1).alias("segment"), F.regexp_extract(path, pattern, 2).alias("part"))
    return F.when(path.rlike(pattern), found)


def parse_segment_part(text: Column) -> Column:
    """struct(segment, part) of ``segment/part``; null where there is no slash."""
    return F.when(F.contains(text, F.lit("/")), F.struct(F.substring_index(text, "/", 1).alias("segment"), F.regexp_replace(text, r"(?s)^[^/]*/", "").alias("part")))
