"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and
share the words of the corpus; a target stops at ``CAP`` times its source's
size and the excess is shared again by weight. That water-filling has a closed
form over the sources sorted by size / weight.

Fitting: documents are counted by exact length per source. A source's target
is whole copies of everything plus a remaining budget; of that, each length
gives its share (rounded so that the running total stays below the ideal one)
until ``RESERVE`` words are left, which a bounded-knapsack dynamic programme
over the lengths' unused counts fills as closely as they allow. Where it leaves
a gap, more is taken back and the programme runs again, until the budget is met
or no more need be taken back (see ``fit``): no choice comes closer. Documents
of a length are then taken in the order of a seeded hash, by salted ranks.

Defined results: null text has size 0 and takes 0; null sources form one
source; repeated rows are separate documents; an empty corpus gives no rows;
columns beside doc_id, text and source may have any name; long texts count
whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, running, salted_rank

CAP, SEED, RESERVE = 3, 17, 20_000


def sizes(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, source and the number of words of the whole text; other columns as they are."""
    return docs.select(*also, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(totals: DataFrame, cap: float = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source.

    Ranks and running sums over the sources come from range-partitioned sorts,
    so a corpus of very many sources does not meet in one task.
    """
    scratch = Scratch(totals.sparkSession)
    weighed = running(totals, [F.col("source").asc_nulls_last()], {"before": F.lit(1)}, scratch).withColumn("weight", F.col("before") % 3 + 1).drop("before", "_at")
    by_share = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    placed = running(weighed, by_share, {"size_before": F.col("source_size"), "weight_before": F.col("weight")}, scratch)
    whole = placed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # With all sources before this one at their caps: the words that each unit of weight gets.
    level = (F.lit(whole["size"]) - cap * F.col("size_before")) / (F.lit(whole["weight"]) - F.col("weight_before"))
    leveled = placed.withColumn("level", level.cast("double"))
    # From the first source on that stays below its cap, its level holds for all.
    held = leveled.where(F.col("level") <= cap * F.col("source_size") / F.col("weight")).agg(F.min(F.struct("_at", "level")).alias("m")).first()["m"]
    full = cap * F.col("source_size")
    target = full if held is None else F.when(F.col("_at") < held["_at"], full).otherwise(F.least(F.lit(held["level"]) * F.col("weight"), full))
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> dict[int, int]:
    """Counts per length (at most those given) whose words come closest to the budget from below."""
    first = np.full(budget + 1, -1, np.int32)  # the item by which a sum was first reached
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for length, count in zip(lengths.tolist(), counts.tolist()):
        count, part = min(count, budget // length), 1
        while count > 0 and not reach[budget]:
            take = min(part, count)
            shift = take * length
            new = ~reach
            new[:shift] = False
            new[shift:] &= reach[: budget + 1 - shift]
            first[new] = len(items)
            reach |= new
            items.append((length, take))
            count, part = count - take, part * 2
        if reach[budget]:
            break
    at, taken = int(np.flatnonzero(reach)[-1]), {}
    while at:
        length, take = items[first[at]]
        taken[length] = taken.get(length, 0) + take
        at -= length * take
    return taken


def _shares(lengths: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """Documents of each length, in proportion and rounded down to at most so many words."""
    out, total = np.zeros(len(lengths), np.int64), int((lengths * counts).sum())
    ideal = taken = 0.0
    for i in np.argsort(-lengths):
        if lengths[i]:
            ideal += lengths[i] * counts[i] * (max(0, words) / total)
            out[i] = max(0, min(counts[i], int((ideal - taken) // lengths[i])))
            taken += out[i] * lengths[i]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, reserve: int = RESERVE) -> tuple[int, np.ndarray]:
    """Whole copies of every document, and how many documents of each length are taken once more.

    The last try takes back twice as many documents of each length as the
    longest has words. That is enough: going from the shares to the closest
    best choice, documents can be added and dropped in an order that keeps the
    running sum within the longest length of 0; a sum that came twice would
    mark equal words dropped and added, which a closer choice leaves alone. So
    the sums differ, and fewer than twice the longest length are dropped.
    """
    extra = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if not total:
        return 0, extra
    copies = min(int(target // total), CAP)
    budget = min(int(round(target)) - copies * total, total)
    if copies >= CAP or budget <= 0:
        return copies, extra
    first = _shares(lengths, counts, budget - reserve)
    enough = 2 * int(lengths[counts > 0].max())
    while True:
        last = reserve >= min(budget, enough * enough // 2)
        extra = np.maximum(first - enough, 0) if last else _shares(lengths, counts, budget - reserve)
        left = budget - int((extra * lengths).sum())
        open_ = np.flatnonzero((counts > extra) & (lengths > 0) & (lengths <= left))
        open_ = open_[np.argsort(-lengths[open_])]
        for length, more in knapsack(lengths[open_], (counts - extra)[open_], left).items():
            extra[lengths == length] += more
        if last or int((extra * lengths).sum()) == budget:
            return copies, extra
        reserve *= 4


def mix(docs: DataFrame, cap: int = CAP, seed: int = SEED, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document; other columns of docs on request."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.cut(sizes(docs, *also))
    hist = scratch.cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    aims = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cap)
    counted = hist.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        copies, extra = fit(part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64), float(part["target"].iloc[0]))
        return part.drop(columns="n").assign(base=copies, extra=extra)

    quotas = counted.groupBy("source").applyInPandas(plan, "source string, size long, source_size long, target double, base long, extra long")
    quotas = scratch.cut(quotas.select("source", "size", "source_size", "target", "base", "extra")).withColumnRenamed("source", "s").withColumnRenamed("size", "z")
    ranked = salted_rank(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")), ["source", "size"], ["h", "doc_id"])
    out = ranked.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    out = out.withColumn("copies", F.col("base") + (F.col("rank") < F.col("extra")).cast("long"))
    return out.select(*also, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
