"""One-to-one matchings of candidate pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from .candidates import islands
from .numbering import cut

SCHEMA = "bank_idx long, gl_idx long, score double"
#: Pairs of an island that one task may hold, at about 200 bytes each in Python; larger islands go through rounds first.
ISLAND_PAIRS = 1_000_000


def greedy_pairs(bank: np.ndarray, entry: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Positions taken when pairs are visited by score (descending), bank, entry and both ends must be free."""
    seen_bank, seen_entry, taken = set(), set(), []
    for i in np.lexsort((entry, bank, -score)).tolist():
        b, e = bank[i], entry[i]
        if b not in seen_bank and e not in seen_entry:
            seen_bank.add(b)
            seen_entry.add(e)
            taken.append(i)
    return np.array(taken, int)


def augmenting_pairs(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A maximum matching by augmenting paths: banks and their entries ascending, depth first, without recursion."""
    adjacent: dict[int, list[int]] = {}
    for b, e in sorted(set(edges)):
        adjacent.setdefault(b, []).append(e)
    mate: dict[int, int] = {}
    for root in sorted(adjacent):
        seen: set[int] = set()
        path: list[tuple[int, int]] = []
        stack = [(root, iter(adjacent[root]))]
        while stack:
            b, rest = stack[-1]
            e = next((x for x in rest if x not in seen), None)
            if e is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            seen.add(e)
            path.append((b, e))
            if e not in mate:
                mate.update((y, x) for x, y in path)
                break
            stack.append((mate[e], iter(adjacent[mate[e]])))
    return sorted((b, e) for e, b in mate.items())


def _greedy(part: pd.DataFrame) -> pd.DataFrame:
    part = part[["bank_idx", "gl_idx", "score"]]
    return part.iloc[greedy_pairs(*(part[c].to_numpy() for c in part.columns))]


def _maximum(part: pd.DataFrame) -> pd.DataFrame:
    pairs = pd.DataFrame(augmenting_pairs(list(zip(part["bank_idx"], part["gl_idx"]))), columns=["bank_idx", "gl_idx"])
    return pairs.merge(part[["bank_idx", "gl_idx", "score"]], on=["bank_idx", "gl_idx"])


def dominance_round(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(taken, still live): pairs that are first for both their ends are what the
    greedy scan takes, since the order of pairs is strict.

    Each end's first pair is a maximum, which combines before the shuffle, so an
    end with very many pairs is no task of its own.
    """
    best = lambda end, other: live.groupBy(end).agg(F.max(F.struct("score", (-F.col(other)).alias("o"))).alias("m")).select(end, (-F.col("m.o")).alias(other), F.col("m.score").alias("score"))
    taken = cut(best("bank_idx", "gl_idx").join(best("gl_idx", "bank_idx").drop("score"), ["bank_idx", "gl_idx"]).select("bank_idx", "gl_idx", "score"))
    rest = live.join(taken.select("bank_idx"), "bank_idx", "left_anti").join(taken.select("gl_idx"), "gl_idx", "left_anti")
    return taken, rest.select(live.columns)


def match_rounds(pairs: DataFrame, config: MatchConfig, hand_over: int = 0) -> DataFrame:
    """Greedy matching in DataFrame rounds; at most ``hand_over`` live pairs go to one task a group at the end.

    pairs is read several times: hand on a stored table.
    """
    live, done = pairs, None
    while (n := live.count()) > hand_over:
        taken, rest = dominance_round(live)
        live = cut(rest)
        done = taken if done is None else done.union(taken)
    if n:
        last = match_grouped(live, config)
        done = last if done is None else done.union(last)
    return done if done is not None else pairs.select("bank_idx", "gl_idx", "score").limit(0)


def components(pairs: DataFrame) -> DataFrame:
    """pairs with ``island``: the connected component, named by its least node.

    Large-star and small-star steps (Kiveris et al. 2014) in turn until nothing
    moves. Banks are the even nodes, entries the odd ones.
    """
    node = lambda c, odd: F.col(c) * 2 + odd
    edges = cut(pairs.select(node("gl_idx", 1).alias("u"), node("bank_idx", 0).alias("v")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The join's key is a result of the aggregate, so a hub's rows are dealt anew and can be split.
        least = both.groupBy("u").agg(F.max("u").alias("k"), F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        down = cut(down)
        least = down.groupBy("u").agg(F.max("u").alias("k"), F.min("v").alias("m")).select("k", "m")
        moved = down.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.union(least.toDF("u", "v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    named = edges.select(F.col("u").alias("_n"), F.col("v").alias("island"))
    # A bank that is the least of its component has no edge of its own.
    return pairs.withColumn("_b", node("bank_idx", 0)).join(named, F.col("_b") == F.col("_n"), "left").select(*pairs.columns, F.coalesce("island", "_b").alias("island"))


def match_grouped(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    """Matching of whole islands in group functions.

    A matching of several islands is the union of theirs, so islands are dealt
    to as many groups as there are shuffle partitions, not to one call each.
    """
    work = _greedy if config.matcher == "greedy" else _maximum
    groups = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pairs if "island" in pairs.columns else islands(pairs, config)
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("island"), F.lit(groups)))
    return dealt.select("part", "bank_idx", "gl_idx", "score").groupBy("part").applyInPandas(work, SCHEMA)


def match(pairs: DataFrame, config: MatchConfig, strategy: str = "auto", island_pairs: int = ISLAND_PAIRS) -> DataFrame:
    """bank_idx, gl_idx, score of the chosen pairs.

    ``auto``: islands in group functions, but of islands beyond ``island_pairs``
    a greedy matching goes in rounds until that few pairs are live, and a maximum
    matching by their connected components; what a single component has beyond
    that is left to one task, as only the whole of it tells which augmenting
    paths there are. ``grouped``: islands in group functions, whatever their size.
    ``rounds``: DataFrame rounds only (greedy).
    """
    if strategy == "grouped":
        return match_grouped(pairs, config)
    stored = cut(pairs.select("bank_idx", "gl_idx", "bank_abs", "gl_abs", "score"))
    if strategy == "rounds":
        return match_rounds(stored, config)
    if stored.count() <= island_pairs:
        return match_grouped(stored, config)
    placed = cut(islands(stored, config))
    large = cut(placed.groupBy("island").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > island_pairs).select("island"))
    if not large.take(1):
        return match_grouped(placed, config)
    own = cut(placed.join(large, "island", "left_semi").drop("island"))
    small = match_grouped(placed.join(large, "island", "left_anti"), config)
    if config.matcher == "greedy":
        return small.union(match_rounds(own, config, hand_over=island_pairs))
    return small.union(match_grouped(cut(components(own)), config))
