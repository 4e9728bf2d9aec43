"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; what it returns is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, with whatever further
columns docs has; helper columns get names that docs does not use.

Near-duplicates and mixing decide on each row by a key of its own, stored once,
so rows without a doc_id and rows that repeat one are documents like others.
An empty table gives an empty table in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import lines, minhash, mixing, packing, quality
from ledgerloom.llm.common import Scratch, bounded, free_prefix, packed, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, trained on the labelled ones among them.

    Null and empty texts are scored like others, by features that are all 0;
    rows that repeat, or have no doc_id, are judged one by one. Without labels
    of both kinds every document gets the same score, the share of good labels.
    """
    return packed(quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels"))))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line repeats; n_chars, where there is one, follows.

    Null texts stay null, empty ones empty; rows without a doc_id count as the
    last documents; rows that repeat doc_id and text lose the same lines.
    """
    out = lines.dedup_lines(docs, counted=None)
    return packed(out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id.

    A row without a doc_id stays only where its whole group has none. Null and
    blank texts are nobody's duplicates, so all their rows stay.
    """
    scratch, row = Scratch(spark), f"{free_prefix(docs)}row"
    keyed = scratch.cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = scratch.cut(minhash.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id"))
    # A row of each component stays: least doc_id (none: last), then least key.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))
    kept = found.join(keyed.select(row, "doc_id"), row).groupBy("component_id").agg(first.alias("at")).select(f"at.{row}")
    dropped = scratch.cut(found.join(kept, row, "left_anti").select(row))
    return packed(keyed.join(bounded(dropped), row, "left_anti").select(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each row by itself.

    Null sources are one source; null texts and texts without words come as often
    as their source is taken whole.
    """
    scratch, p = Scratch(spark), free_prefix(docs)
    row, copies = f"{p}row", f"{p}copies"
    keyed = scratch.cut(docs.withColumn(row, F.monotonically_increasing_id()))
    mixed = scratch.cut(mixing.mix(keyed, also=(row,)).where("copies > 0").select(row, F.col("copies").cast("int").alias(copies)))
    taken = keyed.join(bounded(mixed), row)
    return packed(taken.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences; null and empty texts have the closing id alone."""
    return packed(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages hold a trained model, near-duplicate components and a knapsack: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; a stage's own tables go when its rows are written."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        mark, before = Scratch.mark(), docs
        docs = scratch.cut(stage(spark, docs, sf_dir))
        Scratch.clear(mark)
        scratch.drop(before)
    return docs
