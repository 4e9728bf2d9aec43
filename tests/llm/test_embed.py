import numpy as np

from ledgerloom.llm import embed as E


def _brute(vectors, labels):
    x = np.array(vectors, np.float32).astype(float)
    norm = np.linalg.norm(x, axis=1)
    hit = (x @ x.T / np.outer(norm, norm) >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    low = np.arange(len(x))
    while True:
        now = np.minimum(low, np.where(hit, low[None, :], len(x)).min(axis=1))
        if (now == low).all():
            return hit.sum(axis=1), low
        low = now


def test_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    vectors = np.concatenate([centres[rng.integers(0, 30, 260)] + 0.12 * rng.standard_normal((260, 16)), np.repeat(centres[:2], 25, axis=0)])
    labels = rng.integers(0, 2, len(vectors))
    rows = [(i, [float(v) for v in np.float32(x)], int(c), 1, 2) for i, (x, c) in enumerate(zip(vectors, labels))]
    n, low = _brute(vectors, labels)
    for block in (512, 8):
        got = sorted(E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int, rep int").repartition(3), block=block).collect())
        assert sum(r["n_links"] for r in got) >= 0.99 * n.sum()
        assert [r["n_links"] for r in got] == n.tolist()
        assert [r["component_id"] for r in got] == low.tolist()
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_nulls_zeros_and_no_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()]
    assert sorted(r for r in got if r[0] is not None) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))])
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
