"""Ledger lines to journal entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.text import concat_nonempty, tokenize
from .numbering import numbered


def decimal_total(value: Column) -> Column:
    """Sum in cents, whatever the order; nan if a value is none, null if one is beyond 1e15."""
    odd = F.max(F.when(F.isnan(value) | (F.abs(value) == float("inf")), 1))
    large = F.max(F.when(F.abs(value) >= 1e15, 1))
    cents = F.coalesce(F.sum(F.when(F.abs(value) < 1e15, value).cast("decimal(18,2)")), F.lit(0)).cast("double")
    return F.when(odd == 1, F.lit(float("nan"))).when(large.isNull(), cents)


def ordered_total(lines: Column, compensated: bool) -> Column:
    """Sum of the doubles v of an array of lines, one after the other; null ones are skipped."""
    values = F.filter(F.transform(lines, lambda x: x.v), lambda v: v.isNotNull())
    if not compensated:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def step(acc: Column, v: Column) -> Column:
        add = v - acc.lost
        now = acc.sum + add
        lost = now - acc.sum - add
        return F.struct(now.alias("sum"), F.when(F.isnan(lost), F.lit(0.0)).otherwise(lost).alias("lost"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost")), step, lambda acc: acc.sum)


def aggregate_entries(lines: DataFrame, config: MatchConfig, number: bool = True) -> DataFrame:
    """One row per journal_entry_id of (line_no, journal_entry_id, datetime, ts, amount, description).

    First values follow line_no, never the order in which rows arrive, and
    combine before the shuffle. An entry's lines meet in one row where its total
    or its text needs them in order; that is bounded by the entry, whose text
    holds them all anyway. The ``decimal`` total with the ``first`` text has no
    such row. gl_idx takes a sort of the entries; leave it out with ``number``
    where indexes are not needed.
    """
    rows = lines if config.null_keys else lines.where(F.col("journal_entry_id").isNotNull())
    value = F.coalesce("amount", F.lit(0.0)) if config.bad_amount_zero else F.col("amount")
    # An entry's lines in order, as far as its total and its text need them.
    need = [value.alias("v")] * (config.total != "decimal") + [F.col("description")] * (config.description == "concat")
    ordered = F.sort_array(F.collect_list(F.struct("line_no", *need)))
    total = decimal_total(value) if config.total == "decimal" else ordered_total(F.col("_lines"), config.total == "compensated")
    if config.description == "concat":
        text = concat_nonempty(F.transform("_lines", lambda x: x.description))
        when, stamp = F.min_by("datetime", "line_no"), F.min_by(F.struct("ts"), "line_no").getField("ts")
    else:
        text = F.min_by("description", F.when(F.col("description").isNotNull(), F.col("line_no")))
        dated = F.when(F.col("ts").isNotNull(), F.col("line_no"))
        when, stamp = F.min_by("datetime", dated), F.min_by("ts", dated)
    # Aggregates first, then what is worked out from an entry's lines.
    of_lines = {"gl_amount": total, "gl_description": text}
    late = [c for c, own in (("gl_amount", config.total != "decimal"), ("gl_description", config.description == "concat")) if own]
    early = [of_lines[c].alias(c) for c in of_lines if c not in late] + ([ordered.alias("_lines")] if need else [])
    out = rows.groupBy("journal_entry_id").agg(F.min("line_no").alias("_first"), when.alias("gl_datetime"), stamp.alias("gl_ts"), *early)
    out = out.select("journal_entry_id", "_first", "gl_datetime", "gl_ts", *[of_lines[c].alias(c) if c in late else F.col(c) for c in of_lines])
    if number:
        out = numbered(out, ["_first"] if config.entry_order == "first_seen" else ["journal_entry_id"], "gl_idx")
    else:
        out = out.withColumn("gl_idx", F.lit(None).cast("long"))
    return out.select("gl_idx", "journal_entry_id", "gl_datetime", "gl_ts", F.to_date("gl_ts").alias("gl_day"), "gl_amount", "gl_description", tokenize(F.col("gl_description")).alias("gl_tokens"))


def entry_dates(lines: DataFrame) -> DataFrame:
    """The first readable date of each key."""
    return lines.where(F.col("journal_entry_id").isNotNull() & F.col("ts").isNotNull()).groupBy("journal_entry_id").agg(F.min_by("ts", "line_no").alias("entry_ts"))
