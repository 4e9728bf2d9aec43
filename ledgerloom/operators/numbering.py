"""Row numbers over whole tables without sorting them in one task, and tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written to, and read from, the session's shared checkpoint folder; it goes when the driver's JVM ends.

    In local mode, where the session names no folder, one of our own is set.
    Executors of a cluster would not see it, so there that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def count_up(tagged: DataFrame, at: str, name: str) -> DataFrame:
    """0-based numbers in the order of ``at``, a stored or stable monotonically_increasing_id.

    Its upper bits are the partition; where each begins follows from the
    partitions' counts, a row for each.
    """
    part = F.shiftright(at, 33)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = tagged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return rows.withColumn(name, (F.col(at) - F.shiftleft("_part", 33) + F.col("_start")).cast("long")).drop("_part", "_start", at)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with its 0-based place in a total order: a range-partitioned sort, stored once.

    df is stored first, as the sort reads it twice: for the ranges, and for the rows.
    """
    return count_up(cut(cut(df).orderBy(*order).withColumn("_at", F.monotonically_increasing_id())), "_at", name)


def sums_before(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over the rows before it in a total order.

    A range-partitioned sort is stored; sums run within its partitions, and the
    partitions' totals, a row for each, tell where each begins.
    """
    rows = cut(cut(df).orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(starts), "_part")
    return rows.select(*df.columns, (F.col("_own") + F.col("_start")).cast("long").alias(name))
