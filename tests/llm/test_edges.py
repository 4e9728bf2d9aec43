"""Defined results of operators and pipeline stages on odd tables."""

import bisect
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerloom.llm import licences, lines, mixing, quality, rules
from ledgerloom.llm.common import Scratch

LONG = "word other " * 150_000
#: Names that stages use inside, with values that must come back.
CLASH = ("_row", "_copies", "_copy", "_id", "_line_dedup", "_doc", "component_id", "rank", "id", "y")


def _good(k):
    return f"Document {k} tells of several things, and of others; it ends here.\nA second line {k} follows the first one, as lines do."


@pytest.fixture
def tables(spark, tmp_path):
    labels = [(k, int(k % 3 > 0), 0) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def _documents(spark, rows):
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), *range(len(CLASH))) for d, t, s in rows], shape)


ODD = [(None, None, None), (None, "", "a"), (1, "", None), (2, None, "b"), (3, "x", "a"), (3, "x", "a"), (3, "y z", "a"), (4, LONG, "b"), (None, LONG, "b"), (5, "\n\n \n", "c")]


@pytest.mark.parametrize("name, stage", P.STAGES[:4])
def test_stage_on_odd_rows(spark, tables, name, stage):
    rows = ODD + [(10 + k, _good(k) if k % 3 else f"$$ ## {k} " * (k + 3), "abc"[k % 3]) for k in range(60)]
    docs = _documents(spark, rows)
    out = stage(spark, docs, tables)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(tuple(r[c] for c in CLASH) == tuple(range(len(CLASH))) for r in got)
    before, after = Counter((d, s) for d, _, s in rows), Counter((r["doc_id"], r["source"]) for r in got)
    if name == "line_dedup":
        assert after == before
    elif name == "near_duplicates":
        assert after == before - Counter([(3, "a"), (None, "b")])
    elif name == "mixing":
        want = Counter()
        for r in mixing.mix(docs).collect():
            want[(r["doc_id"], r["source"])] += r["copies"]
        assert after == +want
    else:
        assert not after - before


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stage_on_no_rows(spark, tables, name, stage):
    docs = _documents(spark, ODD).limit(0)
    out = stage(spark, docs, tables)
    assert out.count() == 0
    if name != "packing":
        assert out.columns == docs.columns


def test_scores_by_hand(spark, documents):
    """Scores are the sums of what each feature's and pair's table holds at its bin."""
    rows = [(k, (_good(k) if k % 3 else "$$ ## 11 " * (k % 40 + 3)) + " more" * (k % 7)) for k in range(400)] + [(900, None), (901, ""), (902, LONG), (1, _good(1))]
    docs = documents(rows)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(400)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.tables and model.pairs

    def by_hand(text):
        x, total = quality.features(text), model.base
        for edges, table, v in zip(model.edges, model.tables, x):
            total += table[bisect.bisect_right(edges.tolist(), v)]
        for i, j, grid in model.pairs:
            total += grid[bisect.bisect_right(model.coarse[i].tolist(), x[i])][bisect.bisect_right(model.coarse[j].tolist(), x[j])]
        return 1 / (1 + np.exp(-min(max(total, -30), 30)))

    want = Counter((d, round(float(by_hand(t)), 9)) for d, t in rows)
    got = quality.score(docs, model).collect()
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in got) == want
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality.score(docs.limit(0), model).count() == 0


def test_repeated_rows_train_once(spark, documents):
    once = [(k, _good(k) if k % 3 else "$$ ## 11 " * (k + 3)) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)], "doc_id long, quality int")
    a, b = quality.train(documents(once), labels), quality.train(documents(once + once[:50] * 9), labels)
    assert all((x == y).all() for x, y in zip(a.tables, b.tables))


def test_long_and_repeated(spark, documents):
    rows = [(1, LONG, "a"), (1, LONG, "a"), (2, None, None), (3, "a b c", "b")]
    sizes = {(r["doc_id"], r["size"]) for r in mixing.mix(documents(rows)).collect()}
    assert sizes == {(1, 300_000), (2, 0), (3, 3)}
    judged = rules.judge(documents(rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["base_failed"]) for r in judged) == Counter({(1, 300_000, True): 2, (2, 0, True): 1, (3, 3, True): 1})
    found = licences.scan(documents([(1, LONG + "Released under the MIT License."), (2, "")])).collect()
    assert {(r["doc_id"], r["labels"]) for r in found} == {(1, "mit"), (2, "")}


def test_counts_replace_a_column_of_their_name(spark, documents):
    line = "the same long line of ten words or more in both of them"
    docs = documents([(1, line), (2, line)]).withColumn("_line_dedup", F.lit(5))
    got = {r["doc_id"]: r["_line_dedup"]["n_removed"] for r in lines.dedup_lines(docs).collect()}
    assert got == {1: 0, 2: 1}


def test_scratch_goes(spark):
    mark = Scratch.mark()
    scratch = Scratch(spark)
    kept = scratch.cut(spark.range(5).toDF("x"))
    path, fs = scratch._at(kept.scratch_path)
    assert fs.exists(path)
    Scratch.clear(mark)
    assert not fs.exists(path) and Scratch.mark() == mark
