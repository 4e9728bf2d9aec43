from collections import Counter

import corpus_pipeline as P
from ledgerloom.llm import mixing


def _text(name, n=40):
    return " ".join(f"{name}{k}" for k in range(n))


def test_near_duplicates_by_row(spark, documents):
    a, b, c = _text("a"), _text("b"), _text("c")
    rows = [(None, a), (7, a), (7, a), (3, a + " more"), (None, b), (None, b), (None, b), (5, c), (5, c), (5, _text("d")), (None, None), (None, None), (9, "")]
    out = P.drop_near_duplicates(spark, documents(rows), "")
    assert out.columns == documents(rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(3, a + " more"), (None, b), (5, c), (5, _text("d")), (None, None), (None, None), (9, "")])


def test_mixing_by_row(spark, documents):
    rows = [(None, _text("w", 1 + 7 * k % 90), "abc"[k % 3]) for k in range(120)] + [(4, _text("v", 1 + k), "abc"[k % 3]) for k in range(60)]
    docs = documents(rows)
    want = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).toDF("source", "n").collect()}
    got = Counter()
    for r in P.mix_sources(spark, docs, "").collect():
        got[r["source"]] += len(r["text"].split())
    assert dict(got) == want
