import random
import zlib

import numpy as np

from ledgerloom.llm import quality as X


def _rows():
    random.seed(10)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        own = [random.choice(words) for _ in range(random.randint(20, 120))]
        good = random.random() < 0.7
        if not good:
            own = random.choice([[w.upper() + "!!" for w in own], [w + "###" for w in own], [own[0]] * len(own)])
        rows.append((i, " ".join(own)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = _rows()
    docs, marked = documents(rows + [(None, "x y"), (2000, None), (2001, ""), (5, rows[5][1])]), spark.createDataFrame(labels + [(None, 1, 0), (5000, None, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    got = X.score(docs, X.train(docs, marked)).collect()
    truth = {d: q for d, q, _ in labels}
    assert len(got) == len(rows) + 4
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    kept = X.accepted(docs, X.train(docs, marked))
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_interactions_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = X.fit(x[:3000], y[:3000])
    assert {0, 1} == set(model.pairs[0][:2])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_without_labels(spark, documents):
    docs = documents([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in X.score(docs, X.train(docs, none)).collect()] == [0.5, 0.5]
    assert X.score(documents([]), X.train(documents([]), none)).count() == 0
