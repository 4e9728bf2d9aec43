"""MinHash near-duplicates of documents on word shingles.

A document's set holds the 64-bit hashes of its distinct 5-word shingles
(words: runs of non-blank characters, A-Z lower-cased; fewer words: the whole
sequence). Equal sets collapse into a class first. Minima under many universal
hash functions ((a*x + b) mod 2^64, upper half) are banded; classes of a band
bucket are checked against the bucket's least class, then, in buckets whose
classes still lie in different components, those beside the largest component
against all, in blocks. Every pair
passes the signature (one bit of each minimum, compared in the join itself)
and then the exact sets before it is a link, so buckets of mutual copies cost
a number of pairs linear in their size.

Bands: 32 of 4 minima. A pair at the threshold of 0.75 shares no band with a
probability of 5e-6; the signature checks lose about 1e-6 of such pairs.

Defined results: null or empty texts, and texts of blanks only, have an empty
set, link with nothing and stay. Repeated rows count as copies; no documents, no
rows. Columns beside doc_id and text may have any name; texts of any length are
taken whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, meet
from .common import WORD, Kept, Scratch, arrow, bounded
from .components import connected_components

BANDS, ROWS, WIDTH, PERCENT = 32, 4, 5, 75
HASHES = BANDS * ROWS
#: Signature bits (of 128) that a pair at the threshold agrees on: 112 on average, deviation 3.7.
LEAST_BITS = 90
#: Minima of a long signature, and how many (by their low bytes) a pair at the threshold agrees on at least: 769 on average, deviation 13.9.
LONG, LEAST_LONG = 1024, 706
#: Bytes of the sets of a block, about, at most.
BLOCK_BYTES = 8 << 20
#: Words whose hashes a worker keeps at most, twice (about 16 MB).
CACHE = 50_000

_rng = np.random.Generator(np.random.PCG64(20240607))
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_STEP = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LONG_A = _rng.integers(0, 2**63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LONG_B = _rng.integers(0, 2**63, LONG, dtype=np.uint64)


_words = Kept(xxhash.xxh3_64_intdigest, CACHE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(width, n)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = _mix(s * _STEP[i] + h[i : n - k + 1 + i])
    return np.unique(s)


def signature(s: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """Upper halves of the minima of a set under each hash function."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(out, (a[:, None] * s[None, at : at + 1024] + b[:, None]).min(axis=1), out=out)
    return out >> np.uint64(32)


def bands(sig: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        key = _mix(key * _STEP[i] + sig.reshape(BANDS, ROWS)[:, i])
    return key.view(np.int64)


def bits(sig: np.ndarray) -> np.ndarray:
    """One bit of each minimum, as two longs."""
    low = (_mix(sig) >> np.uint64(7)).astype(np.uint8) & 1
    return np.packbits(low).view(np.int64)


SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, b1 long, b2 long"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("b1", pa.int64()), ("b2", pa.int64())])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows: list[list] = [[] for _ in _SKETCH]
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                s = shingles(text)
                if len(s):
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    d1, d2 = np.frombuffer(d, np.int64).tolist()
                    sig = signature(s)
                    b1, b2 = bits(sig).tolist()
                    row = (doc, len(s), d1, d2, bands(sig), b1, b2)
                else:
                    row = (doc, 0, None, None, None, None, None)
                for column, x in zip(rows, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SKETCH)], schema=_SKETCH)


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The long signature, the band keys and the whole set of each text."""
    for batch in batches:
        rows = [shingles(text.as_py()) for text in batch.column("text")]
        long = [_mix(signature(s, _LONG_A, _LONG_B)).astype(np.uint8).tobytes() for s in rows]
        keys = [bands(signature(s)).tobytes() for s in rows]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(long, pa.binary()), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in rows], pa.binary())], names=["id", "long", "keys", "own"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _across(rows: pa.Table) -> list[np.ndarray]:
    """Links of a block of the bucket's minority (side 1) with a block of all its members (side 0).

    Members of different components that pass the long signatures are compared
    by their whole sets, the closest first; components that a link has joined
    are one from then on, so a block hands on fewer links than it has components.
    """
    band = rows.column("band")[0].as_py()
    comp, n, rep, side = (rows.column(c).to_numpy() for c in ("comp", "n", "rep", "side"))
    keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(len(rep), BANDS)[:, :band]
    long = np.frombuffer(b"".join(rows.column("long").to_pylist()), np.uint8).reshape(len(rep), LONG)
    sets, every = rows.column("own"), np.flatnonzero(side == 0)
    _, comp = np.unique(comp, return_inverse=True)
    joined = comp.ravel().copy()
    u, v = [], []
    for x in np.flatnonzero(side == 1):
        y = every[(joined[every] != joined[x]) & (100 * np.minimum(n[every], n[x]) >= PERCENT * np.maximum(n[every], n[x]))]
        same = (long[y] == long[x]).sum(axis=1)
        near = same >= LEAST_LONG
        y = y[near][np.argsort(-same[near], kind="stable")]
        y = y[~(keys[y] == keys[x]).any(axis=1)]  # these met in an earlier band
        own = np.frombuffer(sets[int(x)].as_py(), np.uint64) if len(y) else None
        for k in y.tolist():
            if joined[k] != joined[x] and alike(own, np.frombuffer(sets[k].as_py(), np.uint64)):
                joined[joined == joined[k]] = joined[x]
                u.append(max(rep[x], rep[k]))
                v.append(min(rep[x], rep[k]))
    return [np.array(c, np.int64) for c in (u, v)]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts whose full sets reach the threshold; rows come in runs of one v."""
    last: tuple = (None, None)
    for batch in batches:
        u, v, keep = batch.column("u"), batch.column("v"), []
        left, right = batch.column("text_u"), batch.column("text_v")
        for i, k in enumerate(v.to_pylist()):
            if last[0] != k:
                last = (k, shingles(right[i].as_py()))
            keep.append(alike(shingles(left[i].as_py()), last[1]))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], names=["u", "v"])


def sketch(docs: DataFrame) -> DataFrame:
    """Set size, set digest, band keys and signature bits of every document."""
    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _sketches, SKETCH)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the documents with these ids; one row each.

    The id is a result of the aggregate and not its key, so a join on it deals
    its rows anew, and adaptive execution can split what one id has many of.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("text"))
    return texts.join(bounded(ids.select(F.col("id").alias("k"))), "k", "left_semi").groupBy("k").agg(F.max("k").alias("id"), F.min("text").alias("text")).select("id", "text")


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) of class representatives that are links by their full sets.

    The hubs (v) come last, so their texts move once for each split of their
    rows, and rows of one hub stand together.
    """
    texts = _texts(docs, pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct())
    left, right = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    full = pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")
    return arrow(full, _verified, "u long, v long")


def _dealt(placed: DataFrame, open_: DataFrame) -> DataFrame:
    """Members of open buckets as blocks: each block of a bucket's minority (side 1: not of
    its largest component) meets each block of all its members (side 0)."""
    rows = placed.join(open_, "key")
    wide = F.sequence(F.lit(0), F.col("wide") - 1)
    narrow = F.sequence(F.lit(0), F.col("narrow") - 1)
    i, j = F.pmod(F.xxhash64("rep", F.lit(1)), "narrow").cast("int"), F.pmod(F.xxhash64("rep"), "wide").cast("int")
    place = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    all_ = F.transform(narrow, lambda k: place(0, k, j))
    minor = F.when(F.col("comp") != F.col("major"), F.transform(wide, lambda k: place(1, i, k))).otherwise(F.array().cast("array<struct<side:int,i:int,j:int>>"))
    return rows.select("key", "band", "rep", "n", "comp", F.explode(F.concat(all_, minor)).alias("p")).select("key", "band", "rep", "n", "comp", "p.*")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Rows with the same doc_id are one document for verification (its least
    text); rows without a doc_id never represent a class.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.cut(sketch(docs))
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.cut(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("b1").alias("b1"), F.first("b2").alias("b2")))
    banded = classes.select("rep", "n", "b1", "b2", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("most")).where("centre < most").drop("most")
    members = scratch.cut(banded.join(shared, "key"))

    # Every member of a bucket against its least one.
    agree = F.bit_count(F.col("b1").bitwiseXOR(F.col("c1"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("c2"))) <= HASHES - LEAST_BITS
    sized = 100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")
    stars = members.where("rep <> centre").select("rep", "n", "b1", "b2", "centre").distinct()
    hubs = classes.select(F.col("rep").alias("centre"), F.col("n").alias("m"), F.col("b1").alias("c1"), F.col("b2").alias("c2"))
    star_pairs = scratch.cut(stars.join(hubs, "centre").where(agree & sized).select(F.col("rep").alias("u"), F.col("centre").alias("v")))
    links = scratch.cut(_verify(star_pairs, docs))
    found = connected_components(links, scratch)

    # Buckets whose members still lie in different components: the links across.
    placed = members.select("key", "band", "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    placed = scratch.cut(placed.select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("comp")))
    of_key = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).groupBy("key").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.max(F.struct("m", "n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
    blocks = lambda m, n: F.ceil(F.greatest(m / BLOCK, n * 8 / BLOCK_BYTES)).cast("int")
    open_ = scratch.cut(of_key.where("comps > 1").select("key", F.col("top.comp").alias("major"), blocks(F.col("m"), F.col("n")).alias("wide"), blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("narrow")))
    if open_.take(1):
        still = scratch.cut(placed.join(open_, "key", "left_semi").select(F.col("rep").alias("id")).distinct())
        long = scratch.cut(arrow(_texts(docs, still), _long, "id long, long binary, keys binary, own binary")).withColumnRenamed("id", "rep")
        more = scratch.cut(meet(_dealt(placed, open_).join(long, "rep"), _across, ["u", "v"]).distinct())
        if more.take(1):
            found = connected_components(links.union(more), scratch)

    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("c"))
    out = rows.drop("bands", "b1", "b2").join(of_class, ["d1", "d2"], "left").withColumn("component_id", F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The same in DuckDB SQL, over all documents that share a shingle.
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i+{WIDTH - 1}], ' ')) AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {WIDTH - 1}, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
"""
