"""Shared helpers of the training-data operators: workspace, table access, batching."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "crawlframe"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``, or the application has set a checkpoint folder; only where neither is so
    and the master is local (tests) a temporary folder of this machine is taken and set as the checkpoint folder.
    On a cluster without a shared folder this is an error: rows that executors write to disks of their own would be lost.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.conf.get("crawlframe.workspace.dir", None)
    if own is None and context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if own is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if own is None:
        own = f"file://{tempfile.mkdtemp(prefix='crawlframe-')}"
        spark.conf.set("crawlframe.workspace.dir", own)
        context.setCheckpointDir(f"{own}/checkpoints")
    return own.rstrip("/")


class Workspace:
    """Tables written below :func:`shared_dir`; they cut lineage and survive lost executors.

    The folder is removed by :meth:`release`, or when the interpreter ends.
    """

    def __init__(self, spark: SparkSession, kind: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{_BUCKET}/{kind}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()
        atexit.register(self.release)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the table that was written."""
        path = self.path(name)
        self.names.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(target, True)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            self._delete(self.path(name))
            self.names.discard(name)

    def keep(self, *prefixes: str) -> None:
        """Remove all tables but those whose names begin so."""
        self.drop(*[n for n in sorted(self.names) if not n.startswith(prefixes)])

    def release(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session has ended: its storage is the cluster's to clear
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns asked for, by exact name, so that extra columns never clash with computed ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def slices(sizes: list[int], limit: int):
    """Consecutive index ranges whose sizes add up to ``limit`` at most (one item may exceed it alone)."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
