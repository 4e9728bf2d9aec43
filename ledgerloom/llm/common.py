"""Shared helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the six ASCII blanks.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
#: Rows up to which an id list may be broadcast (about 16 bytes a row).
BROADCAST_ROWS = 200_000
#: Bytes that a plan reads for each file that it writes, at least; and bytes of a batch that goes to a Python worker at once.
FILE_BYTES, BATCH_BYTES = 4 << 20, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of our own only in local mode, where none is set.

    Executors of a cluster do not see a folder on the driver's disk, so there
    ``spark.checkpoint.dir`` must name a shared one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def packed(df: DataFrame) -> DataFrame:
    """df in no more partitions than a few a core, or one for each FILE_BYTES that its plan reads.

    A task's output is a file, and hundreds of tiny files cost more than their
    rows. The number follows the input, so at scale it is that of the splits.
    """
    read = bytes_read(df)
    return df if read is None else df.coalesce(max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-read // FILE_BYTES)))


def bytes_read(df: DataFrame) -> int | None:
    """Bytes of the files that the plan of df reads, as they are stored; None if rows come from elsewhere."""
    leaves, read = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator(), 0
    while leaves.hasNext():
        read += int(leaves.next().stats().sizeInBytes())
    return read if read < 1 << 50 else None


class Scratch:
    """Tables written to the shared checkpoint folder, to cut lineage.

    A written table survives lost executors. ``drop`` removes tables that a
    later step has replaced, so iterations do not pile up; the rest goes when
    the driver's JVM ends, or with ``clear`` once nothing reads them.
    """

    _open: ClassVar[threading.local] = threading.local()

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0
        path, fs = self._at(self.base)
        fs.deleteOnExit(path)
        Scratch._opened().append(self)

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        packed(df).write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "scratch_path", None):
                p, fs = self._at(path)
                fs.delete(p, True)

    @classmethod
    def _opened(cls) -> list[Scratch]:
        if not hasattr(cls._open, "all"):
            cls._open.all = []
        return cls._open.all

    @classmethod
    def mark(cls) -> int:
        return len(cls._opened())

    @classmethod
    def clear(cls, mark: int) -> None:
        """Remove the tables of all folders that this thread has opened since the mark."""
        own = cls._opened()
        for scratch in own[mark:]:
            p, fs = scratch._at(scratch.base)
            fs.delete(p, True)
        del own[mark:]


def arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow on batches of at most BATCH_BYTES (one row at least); a worker gives back what it has freed when a task ends.

    The bound is a setting of the session, lowered where it is higher.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key, str(2**31 - 1))) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            released()

    return df.mapInArrow(run, schema)


class Kept(dict):
    """What make gives for a key, kept for the keys met lately: two generations of at most ``most`` keys each."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def released() -> None:
    """Give free memory of this process back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_prefix(docs: DataFrame) -> str:
    """Underscores with which no column of docs begins, for columns of our own."""
    p = "_"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    return p


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """df with a place ``_at`` in the order and, under the given names, the sums over all rows before.

    A range-partitioned sort is stored; sums run within its partitions, and the
    partitions' totals (a row for each) give each its start.
    """
    rows = scratch.cut(df.orderBy(*order).select(*df.columns, *[c.cast("long").alias(f"_{n}") for n, c in sums.items()], F.monotonically_increasing_id().alias("_at")))
    rows = rows.withColumn("_p", F.shiftright("_at", 33))
    totals = rows.groupBy("_p").agg(*[F.sum(f"_{n}").alias(f"_t{n}") for n in sums])
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_p", *[F.coalesce(F.sum(f"_t{n}").over(earlier), F.lit(0)).alias(f"_s{n}") for n in sums])
    within = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(*df.columns, "_at", "_p", *[F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)).alias(n) for n in sums])
    return rows.join(F.broadcast(starts), "_p").select(*df.columns, "_at", *[(F.col(n) + F.col(f"_s{n}")).alias(n) for n in sums])


def salted_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", salts: int = 256) -> DataFrame:
    """0-based rank of each row among the rows of its keys, without one task per key.

    ``order`` must be a total order up to identical rows. Rows are spread by a
    hash of the order columns into salts; a salt's rows are ranked apart and
    the salts' counts (at most ``salts`` rows a key) give each its start.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts)).cast("int")
    rows = df.withColumn("_salt", salt)
    counts = rows.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    renamed = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_salt").alias("_s"), "_start")
    on = F.col("_salt") == F.col("_s")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    ranked = rows.withColumn("_r", within)
    return ranked.join(renamed, on).withColumn(name, (F.col("_start") + F.col("_r") - 1).cast("long")).drop("_salt", "_s", "_start", "_r", *[f"_k{i}" for i in range(len(keys))])
