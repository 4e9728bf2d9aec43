"""Registered corpus queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import embed, licences, lines, minhash, mixing, packing, pii, quality, rules, suffix
from .common import table


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_suffix(spark, sf_dir):
    return suffix.repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3_embedding(spark, sf_dir):
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op6_line_dedup(spark, sf_dir):
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return out.select("doc_id", F.col("_line_dedup.n_lines").cast("long").alias("n_lines"), F.col("_line_dedup.n_removed").cast("long").alias("n_removed"), kept)


def op7_host_rules(spark, sf_dir):
    return rules.judge(table(spark, sf_dir, "documents")).drop("host_rate")


def op8_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries():
    return {"op1_quality": op1_quality, "op2_suffix": op2_suffix, "op3_embedding": op3_embedding, "op4_minhash": op4_minhash, "op5_mixing": op5_mixing, "op6_line_dedup": op6_line_dedup, "op7_host_rules": op7_host_rules, "op8_licences": op8_licences, "op9_pii": op9_pii, "op10_packing": op10_packing}


def oracle_sql():
    """SQL of the queries that it can express; the others are held against brute force in the tests."""
    return {"op3_embedding": embed.SQL, "op4_minhash": minhash.SQL, "op6_line_dedup": lines.SQL, "op7_host_rules": rules.SQL, "op8_licences": licences.sql()}
