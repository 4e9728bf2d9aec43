"""Embedding near-duplicates by random-hyperplane signs in several tables.

Rows that agree in label and vector collapse into a class. Each class gets, in
each of ``TABLES`` tables, the signs of its products with ``BITS`` seeded
hyperplanes. Classes that share label, dimension and signs meet in a bucket,
where their cosines are worked out in double precision. A bucket beyond
``BLOCK`` members is dealt as pairs of blocks, so no task holds more than two
blocks, whatever a bucket's size. A pair counts in the first table in which it
meets. A bucket returns one row for each member that has a link there: the
links, summed over the classes' sizes, and the least member it is connected
with; components are put together from these by large-star and small-star.

A pair at the threshold of 0.93 meets in no table with a probability of 7e-4,
closer pairs more rarely.

Defined results: null labels; null, empty and zero vectors; and vectors with
null or non-finite components link with nothing and stay. Vectors of different
lengths are not compared. Repeated rows are copies of one vector and link with
each other; rows without a vec_id never represent a class; no vectors, no rows.
Columns beside vec_id, label and embedding may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK, deal, meet
from .common import Scratch, arrow
from .components import connected_components

COSINE, BITS, TABLES, SEED = 0.93, 14, 40, 5


def _planes(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((dim, TABLES * BITS))


def codes(vectors: np.ndarray) -> np.ndarray:
    """The signs in each table, as one number each."""
    signs = (vectors @ _planes(vectors.shape[1])) >= 0
    return (signs.reshape(len(vectors), TABLES, BITS) << np.arange(BITS)).sum(axis=2).astype("<u2")


def _pack(kind: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec, label, x in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))):
                raw = d1 = d2 = None
                if label is not None and x and None not in x:
                    v = np.array(x, kind)
                    norm = np.linalg.norm(v.astype(np.float64))
                    if np.isfinite(v).all() and 0 < norm < np.inf:
                        raw = v.tobytes()
                        d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(f"{label}:{len(v)}:".encode() + raw), np.int64).tolist()
                rows.append((vec, label, raw, d1, d2))
            c = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())], names=["vec_id", "label", "vec", "d1", "d2"])

    return pack


def _coded(kind: str):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, labels = batch.column("vec").to_pylist(), batch.column("label").to_pylist()
            out, keys = [None] * len(raw), [None] * len(raw)
            by_dim: dict[int, list[int]] = {}
            for i, r in enumerate(raw):
                by_dim.setdefault(len(r), []).append(i)
            for size, at in by_dim.items():
                c = codes(np.frombuffer(b"".join([raw[i] for i in at]), kind).reshape(len(at), -1).astype(np.float64))
                for i, own in zip(at, c):
                    salt = xxhash.xxh3_64_intdigest(f"{labels[i]}:{size}".encode()) & ((1 << 40) - 1)
                    # A label's 40-bit hash, the table and the signs: 6 + 16 bits below it; equal hashes only cost needless cosines.
                    out[i], keys[i] = own.tobytes(), ((np.uint64(salt) << np.uint64(23)) | (np.arange(TABLES, dtype=np.uint64) << np.uint64(BITS)) | own).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), batch.column("vec"), batch.column("label"), pa.array(out, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "n", "vec", "label", "codes", "keys"])

    return coded


def _links(table: int, cross: bool, first: np.ndarray, ids: np.ndarray, labels: np.ndarray, weight: np.ndarray, x: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members with a link, the least member each is connected with here, and their links that meet here first."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    a, b = (np.flatnonzero(first), np.flatnonzero(~first)) if cross else (np.arange(len(ids)), np.arange(len(ids)))
    hit = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= cosine
    hit &= labels[a][:, None] == labels[b][None, :]
    r, k = np.nonzero(hit if cross else np.triu(hit, 1))
    r, k = a[r], b[k]
    if not len(r):
        return ids[:0], ids[:0], ids[:0]
    new = ~(c[r, :table] == c[k, :table]).any(axis=1)
    links = np.bincount(r[new], weight[k[new]], len(ids)) + np.bincount(k[new], weight[r[new]], len(ids))
    least = np.arange(len(ids))
    while True:
        low = np.minimum(least[r], least[k])
        now = least.copy()
        np.minimum.at(now, r, low)
        np.minimum.at(now, k, low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    own = np.unique(np.concatenate([r, k]))
    return ids[own], ids[least[own]], links[own].astype(np.int64)


def _bucketed(kind: str, cosine: float):
    def work(rows: pa.Table) -> list[np.ndarray]:
        n, first = rows.num_rows, {c: rows.column(c)[0].as_py() for c in ("key", "i", "j")}
        x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), kind).reshape(n, -1).astype(np.float64)
        c = np.frombuffer(b"".join(rows.column("codes").to_pylist()), "<u2").reshape(n, TABLES)
        table = (first["key"] >> BITS) & ((1 << (23 - BITS)) - 1)
        ids, weight, b = (rows.column(k).to_numpy() for k in ("rep", "n", "b"))
        return list(_links(table, first["i"] != first["j"], b == first["i"], ids, np.array(rows.column("label").to_pylist(), object), weight, x, c, cosine))

    return work


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    scratch = Scratch(vectors.sparkSession)
    kind = "<f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) or isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), T.FloatType) else "<f8"
    numbers = "array<float>" if kind == "<f4" else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(numbers).alias("embedding"))
    rows = scratch.cut(arrow(base, _pack(kind), "vec_id long, label string, vec binary, d1 long, d2 long"))
    classes = rows.where("vec is not null and vec_id is not null").groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"), F.first("label").alias("label"))
    classes = scratch.cut(classes)
    coded = scratch.cut(arrow(classes.select("rep", "n", "vec", "label"), _coded(kind), "rep long, n long, vec binary, label string, codes binary, keys array<long>"))

    spread = coded.select("rep", F.explode("keys").alias("key"))
    crowded = spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    filled = deal(spread, crowded, "rep", block).join(coded.select("rep", "n", "vec", "label", "codes"), "rep")
    met = meet(filled, _bucketed(kind, cosine), ["a", "b", "n"])
    met = scratch.cut(met)
    links = met.groupBy("a").agg(F.sum("n").alias("links"))
    found = connected_components(met.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    of_class = classes.select("d1", "d2", "rep", "n").join(links.withColumnRenamed("a", "rep"), "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("d1", "d2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("l"), F.coalesce("component", "rep").alias("c"))
    out = rows.drop("vec", "label").join(of_class, ["d1", "d2"], "left").withColumn("component_id", F.coalesce("c", "vec_id"))
    return out.select("vec_id", F.coalesce("l", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The same in DuckDB SQL, over all pairs.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {COSINE}),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
