"""Buckets of any size as blocks and pairs of blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

BLOCK = 512
#: Bytes of rows that are gathered before groups are worked on, about.
HELD_BYTES = 16 << 20


def deal(members: DataFrame, crowded: DataFrame, member: str, block: int = BLOCK) -> DataFrame:
    """members (key, member, ...) of the keys in crowded (key, m) with columns b, i, j.

    A key of m members gets ceil(m / block) blocks; a member's block is b, and
    it goes to every pair of blocks (i <= j) that holds b.
    """
    sized = crowded.select("key", F.ceil(F.col("m") / block).cast("int").alias("_blocks"))
    dealt = members.join(sized, "key").withColumn("b", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("i", F.least("b", "_o")).withColumn("j", F.greatest("b", "_o")).drop("_o", "_blocks")


def each_pair_of_blocks(work: Callable[[pa.Table], list[np.ndarray]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by key, i, j: work on the rows of each group, longs out.

    No more than one group (two blocks) and one batch are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
            edges = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds = [0, *edges.tolist(), rows.num_rows]
            if not last:
                bounds.pop()
            out = [work(rows.slice(s, e - s)) for s, e in zip(bounds, bounds[1:]) if e - s > 1]
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names), rows.slice(bounds[-1])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, now]).combine_chunks() if held is not None and held.num_rows else now
            if held.num_rows >= 2048 or held.nbytes >= HELD_BYTES:
                out, held = done(held, False)
                yield out
        if held is not None and held.num_rows:
            yield done(held, True)[0]

    return run


def meet(dealt: DataFrame, work: Callable[[pa.Table], list[np.ndarray]], names: list[str]) -> DataFrame:
    """Rows of longs from work over every pair of blocks."""
    return arrow(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), each_pair_of_blocks(work, names), ", ".join(f"{n} long" for n in names))
