"""Candidate pairs: a band join on amounts, as an equi-join on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.text import indel_ratio, jaccard
from .numbering import cut, numbered

#: Distinct amount buckets that one task may rank.
WINDOW_BUCKETS = 1_000_000


def _valid(df: DataFrame, side: str, config: MatchConfig) -> DataFrame:
    amount = F.col(f"{side}_amount")
    ok = F.col(f"{side}_ts").isNotNull() & amount.isNotNull() & (F.abs(amount) < float("inf"))
    return df.where(ok & F.col(f"{side}_description").isNotNull() if config.need_description else ok)


def valid_bank(bank: DataFrame, config: MatchConfig) -> DataFrame:
    return _valid(bank, "bank", config)


def valid_entries(entries: DataFrame, config: MatchConfig) -> DataFrame:
    return _valid(entries, "gl", config)


def within_days(config: MatchConfig) -> Column:
    if config.day_rule == "calendar":
        return F.abs(F.datediff("bank_day", "gl_day")) <= config.day_window
    micros = F.unix_micros(F.col("bank_ts").cast("timestamp")) - F.unix_micros(F.col("gl_ts").cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000.0)).between(-config.day_window, config.day_window)


def within_amount(config: MatchConfig) -> Column:
    return F.abs(F.abs("bank_amount") - F.abs("gl_amount")) <= F.lit(config.tolerance)


def candidates(bank: DataFrame, entries: DataFrame, config: MatchConfig, day_buckets: bool = False) -> DataFrame:
    """bank_idx, gl_idx, amounts and score of every pair within the windows.

    An entry has one amount bucket, a bank row the one or two that its padded
    interval touches, so each pair meets once and the exact predicates decide.
    ``day_buckets`` adds the date to the key where one amount is very common.
    """
    width, pad = config.bucket_width, 2 * config.tolerance
    a = F.abs("bank_amount")
    left = valid_bank(bank, config).withColumn("k", F.explode(F.array_distinct(F.array(F.floor((a - pad) / width), F.floor((a + pad) / width)))))
    right = valid_entries(entries, config).withColumn("k", F.floor(F.abs("gl_amount") / width))
    keys = ["k"]
    if day_buckets:
        span = config.day_window + 1
        number = lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) / span)
        left = left.withColumn("d", F.explode(F.sequence(number("bank_ts") - 1, number("bank_ts") + 1)))
        right = right.withColumn("d", number("gl_ts"))
        keys.append("d")
    pairs = left.join(right, keys).where(within_days(config) & within_amount(config))
    return _scored(pairs, config)


def candidates_naive(bank: DataFrame, entries: DataFrame, config: MatchConfig) -> DataFrame:
    """The same by comparing all rows; for tests only."""
    return _scored(valid_bank(bank, config).join(valid_entries(entries, config), within_days(config) & within_amount(config)), config)


def pair_score(config: MatchConfig) -> Column:
    if config.similarity == "jaccard":
        return jaccard(F.col("bank_tokens"), F.col("gl_tokens"))
    return F.levenshtein(F.coalesce("bank_description", F.lit("")), F.coalesce("gl_description", F.lit(""))).cast("double")


def _scored(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    return pairs.select("bank_idx", "gl_idx", F.abs("bank_amount").alias("bank_abs"), F.abs("gl_amount").alias("gl_abs"), pair_score(config).alias("score"))


def islands(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    """pairs with ``island``: no candidate connects two islands.

    Amounts are cut into buckets of two tolerances; a gap of more than one
    bucket separates islands. In a run without gaps, a bucket less its rank among
    the distinct buckets is constant, which names the island; the ranks take a
    window only where the buckets are few, else a range-partitioned sort.
    """
    width = 2 * config.tolerance
    bucket = lambda c: F.floor(F.col(c) / width)
    named = named_islands(pairs.select(F.explode(F.array(bucket("bank_abs"), bucket("gl_abs"))).alias("bucket")).distinct())
    return pairs.withColumn("bucket", bucket("bank_abs")).join(named, "bucket").drop("bucket")


def named_islands(used: DataFrame) -> DataFrame:
    """bucket, island of distinct buckets; a gap of more than one bucket separates islands."""
    used = cut(used)
    ranked = used.withColumn("r", F.row_number().over(Window.orderBy("bucket"))) if used.count() <= WINDOW_BUCKETS else numbered(used, ["bucket"], "r")
    return ranked.select("bucket", (F.col("bucket") - F.col("r")).alias("island"))


def with_ratio(rows: DataFrame) -> DataFrame:
    """rows with the indel similarity of the two descriptions as score."""
    return rows.withColumn("score", indel_ratio(F.coalesce("gl_description", F.lit("")), F.coalesce("bank_description", F.lit(""))))
