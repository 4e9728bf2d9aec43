"""Host-level quality rules, in DataFrame operations only.

Each document is judged by rules; failures are summed by host (``source``).
A host's failure rate is shrunk towards the corpus rate by a beta prior whose
strength is fitted to the spread of the hosts' rates (method of moments), and
the verdict joins back to the host's documents: a document stays if it passes
the rules itself and its host's shrunk rate is at most ``HOST_RATE``.

Defined results: null and empty texts have no words and fail; null hosts form
one host; repeated rows are judged one by one; no documents, no rows. Columns
beside doc_id, text and source may have any name; long texts count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, Scratch, bounded

WINDOW, LEAST_WORDS, REPEAT_PERCENT, SYMBOL_PERCENT, HOST_RATE = 8, 20, 30, 20, 0.5


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words of an array (as hashes) in windows that occur twice or more."""
    n = F.size(hashes)
    windows = F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(hashes, i, width)))).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        return let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: let(F.sort_array(F.filter(F.transform(s, lambda x, k: F.when((x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h), x.i)), lambda i: i.isNotNull())), lambda at: F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - i, F.lit(width)))), F.lit(0), lambda a, b: a + b)))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host and the measures of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("text"))
    words = F.filter(F.split("text", f"[{BLANK}]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(f"[^{BLANK}]"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: repeated_words(h)).alias("n_repeat_words")))
    of_lines = let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s)))
    rows = rows.select("doc_id", "host", of_words.alias("w"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"), of_lines.alias("n_dup_lines"))
    return rows.select("doc_id", "host", *[F.col(c).cast("long").alias(c.removeprefix("w.")) for c in ("w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")])


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta parameters of the hosts' failure rates, from (n, failed) per host."""
    s = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ff")).first()
    if not s["n"]:
        return 1.0, 1.0
    mean = min(max(s["f"] / s["n"], 1e-6), 1 - 1e-6)
    spread = s["ff"] / s["n"] - (s["f"] / s["n"]) ** 2  # of the rates, by documents
    between = max(spread - s["hosts"] * mean * (1 - mean) / s["n"], 1e-9)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """The measures of every document with base_failed, host_rate and kept."""
    scratch = Scratch(docs.sparkSession)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    fails = base | (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("n_words"))
    rows = scratch.cut(measures(docs).withColumn("base_failed", base).withColumn("failed", fails))
    hosts = scratch.cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failed")))
    a, b = prior(hosts)
    verdicts = hosts.select(F.col("host").alias("h"), ((F.col("failed") + a) / (F.col("n") + a + b)).alias("host_rate"))
    out = rows.join(bounded(verdicts), F.col("host").eqNullSafe(F.col("h")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("failed") & (F.col("host_rate") <= host_rate)).alias("kept"))


#: The same in DuckDB SQL; hash collisions apart, windows are compared as texts.
SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^{BLANK}]+') AS words FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, sum(step)::BIGINT AS n_repeat_words FROM (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS step FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^{BLANK}]')) AS lines FROM d),
m AS (SELECT d.doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > {SYMBOL_PERCENT} * n_words AS failed FROM b),
h AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS k FROM f GROUP BY host),
p AS (SELECT sum(n) AS n, least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6) AS mean, sum(k * k / n) / sum(n) - pow(sum(k) / sum(n), 2) AS spread, count(*) AS hosts FROM h),
q AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(spread - hosts * mean * (1 - mean) / n, 1e-9) - 1, 1.0), 1e6) AS strength FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT failed AND (k + mean * strength) / (h.n + strength) <= {HOST_RATE} AS kept
FROM f JOIN h ON f.host IS NOT DISTINCT FROM h.host CROSS JOIN q
"""
