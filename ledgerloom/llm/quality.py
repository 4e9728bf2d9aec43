"""Quality classifier: a generalised additive model with pairwise interactions.

Lou et al., "Accurate Intelligible Models with Pairwise Interactions" (2013).
Features of the whole text are cut into quantile bins. Boosting cycles over
the features; each turn fits a tree of at most three leaves to the logistic
gradient by bin and adds it to the feature's lookup table. The pairs of
features with the largest gain on what is left then get tables over coarse
bins, by trees of depth two. A score is the sum of the looked-up values,
through the logistic function.

Fitting uses the labelled rows with crc32(doc_id as text) mod 5 <> 0, at most
``SAMPLE`` of them (the first in a seeded hash order of doc_id); scoring is one
pass over the documents without a shuffle.

Defined results: null and empty texts have all features 0 and get a score;
rows without a doc_id are scored and never learned from; without labels of
both kinds every score is the (smoothed) share of good labels; rows that share a
doc_id are scored one by one and learned from once (the least text); no
documents, no rows. Columns beside doc_id and text may have any name; texts of
any length are taken whole, one at a time.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, bounded

SAMPLE, SEED, THRESHOLD = 20_000, 11, 0.3
BINS, COARSE, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAST = 32, 8, 150, 6, 60, 0.1, 20
FEATURES = ("log_words", "word_bytes", "upper", "digits", "symbols", "exclaims", "stops", "wide", "distinct", "adjacent", "pairs", "line_words", "dup_lines", "blanks")

_SYMBOLS = np.frombuffer(b"#*$%&|<>_=~^@{}[]\\", np.uint8)


def features(text: str | None) -> list[float]:
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    lines = [x for x in b.split(b"\n") if x]
    held = int(hist.sum() - hist[[9, 10, 11, 12, 13, 32]].sum())
    letters = int(hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum()) or 1
    return [
        float(np.log1p(n)), held / n, int(hist[65:91].sum()) / letters, int(hist[48:58].sum()) / held, int(hist[_SYMBOLS].sum()) / n, int(hist[33]) / n, int(hist[[44, 46]].sum()) / n, int(hist[128:].sum()) / letters,
        len(set(words)) / n ** 0.85, sum(map(operator.eq, words, words[1:])) / n, len(set(zip(words, words[1:]))) / n, float(np.log1p(n / max(len(lines), 1))), 1 - len(set(lines)) / max(len(lines), 1), 1 - held / len(b),
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The best cut of a row of bins: gain, and the bins on its left."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < LEAST) | (n.sum() - nl < LEAST)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Newton steps of a shallow tree over a row of bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [_split(g[a:b], h[a:b], n[a:b]) for a, b in parts]
        k = max(range(len(parts)), key=lambda i: cuts[i][0])
        if cuts[k][0] <= 0:
            break
        a, b = parts.pop(k)
        parts += [(a, a + cuts[k][1]), (a + cuts[k][1], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree of depth two over a grid: one cut of an axis, then one of the other on each side."""
    best, out = 0.0, np.zeros(g.shape)
    whole = float(_gain(g.sum(), h.sum()))
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        for s in range(1, len(a)):
            steps, total = np.zeros(a.shape), 0.0
            for side in (slice(0, s), slice(s, None)):
                u, v, w = a[side].sum(0), b[side].sum(0), c[side].sum(0)
                gain, at = _split(u, v, w)
                for part in ((slice(0, at), slice(at, None)) if gain > 0 else (slice(None),)):
                    steps[side, part] = -u[part].sum() / (v[part].sum() + 1.0)
                    total += float(_gain(u[part].sum(), v[part].sum()))
            if total - whole > best + 1e-12:
                best, out = total - whole, steps.T if turned else steps
    return best, out


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)  # fine bins by feature
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features: a lookup for each feature and pair."""
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for i, j, grid in self.pairs:
            total += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return _sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k))
    model.edges, model.coarse = [cuts(v, BINS) for v in x.T], [cuts(v, COARSE) for v in x.T]
    bins = [np.searchsorted(e, v, "right") for e, v in zip(model.edges, x.T)]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    counts = [np.bincount(b, minlength=s) for b, s in zip(bins, sizes)]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for f, (b, s) in enumerate(zip(bins, sizes)):
            p = _sigmoid(total)
            step = RATE * _tree(np.bincount(b, p - y, s), np.bincount(b, p * (1 - p), s), counts[f])
            model.tables[f] += step
            total += step[b]
    low = [np.searchsorted(e, v, "right") for e, v in zip(model.coarse, x.T)]
    wide = [len(e) + 1 for e in model.coarse]

    def grid(i: int, j: int, w: np.ndarray | None) -> np.ndarray:
        return np.bincount(low[i] * wide[j] + low[j], w, wide[i] * wide[j]).reshape(wide[i], wide[j])

    p = _sigmoid(total)
    gains = sorted(((-_tree2(grid(i, j, p - y), grid(i, j, p * (1 - p)), grid(i, j, None))[0], i, j) for i in range(x.shape[1]) for j in range(i) if wide[i] > 1 and wide[j] > 1))
    model.pairs = [(i, j, np.zeros((wide[i], wide[j]))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            p = _sigmoid(total)
            step = RATE * _tree2(grid(i, j, p - y), grid(i, j, p * (1 - p)), grid(i, j, None))[1]
            table += step
            total += step[low[i], low[j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["y", "doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model:
    """A model of labels.quality, from at most ``sample`` labelled documents that are not held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q")).where(F.col("q").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    marked = marked.groupBy("id").agg(F.max("q").alias("y")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows that share a doc_id are one document here (its least text), so no more than the sample are collected.
    rows = texts.join(bounded(marked, sample), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "doc_id", "text")
    found = sorted((r["doc_id"], r["y"], *r["x"]) for r in arrow(rows, _featured, "y int, doc_id long, x array<double>").collect())
    a = np.array(found, float).reshape(len(found), 2 + len(FEATURES))
    return fit(a[:, 2:], a[:, 1])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.array([features(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    out = arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text the model accepts."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.array([features(t.as_py()) for t in batch.column(at)]).reshape(batch.num_rows, len(FEATURES)))
            yield batch.filter(pa.array(s >= threshold))

    return arrow(docs, keep, docs.schema)
