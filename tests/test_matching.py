import random

from ledgerloom.config import GREEDY, MAXFLOW
from ledgerloom.operators import candidates as C
from ledgerloom.operators import matching as M
from pyspark.sql import functions as F


def _sequential(edges):
    banks, entries, out = set(), set(), set()
    for s, b, e in sorted((-s, b, e) for b, e, s in edges):
        if b not in banks and e not in entries:
            banks.add(b), entries.add(e), out.add((b, e))
    return out


def _graph(seed, n=12):
    random.seed(seed)
    return [(b, e, random.choice([0.0, 0.5, 1.0])) for b in range(n) for e in range(n) if random.random() < 0.3]


def _dense_flow(edges, n):
    """Depth-first augmenting on a dense residual matrix, nodes ascending."""
    size = 2 * n + 2
    residual = [[0] * size for _ in range(size)]
    for b in range(n):
        residual[0][1 + b] = residual[1 + n + b][size - 1] = 1
    for b, e, _ in edges:
        residual[1 + b][1 + n + e] = 1
    while True:
        seen, path = set(), []

        def walk(u):
            seen.add(u)
            for v in range(size):
                if v not in seen and residual[u][v] > 0:
                    if v == size - 1 or walk(v):
                        path.append((u, v))
                        return True
            return False

        if not walk(0):
            break
        for u, v in path:
            residual[u][v] -= 1
            residual[v][u] += 1
    return {(b, e) for b, e, _ in edges if residual[1 + b][1 + n + e] == 0}


def test_augmenting_pairs_are_those_of_a_dense_flow():
    for seed in range(3000):
        edges = _graph(seed, n := 1 + seed % 9)
        assert set(M.augmenting_pairs([(b, e) for b, e, _ in edges])) == _dense_flow(edges, n)


def test_a_vertex_cover_of_equal_size(spark):
    """Koenig: a cover of all pairs with as many vertices as there are matches proves that no more are possible."""
    for seed in range(300):
        edges = [(b, e) for b, e, _ in _graph(seed, 14)]
        mate = {b: e for b, e in M.augmenting_pairs(edges)}
        back = {e: b for b, e in mate.items()}
        reach, open_ = {("b", b) for b, _ in edges if b not in mate}, [b for b, _ in edges if b not in mate]
        while open_:
            b = open_.pop()
            for x, e in edges:
                if x == b and ("e", e) not in reach:
                    reach.add(("e", e))
                    if e in back and ("b", back[e]) not in reach:
                        reach.add(("b", back[e]))
                        open_.append(back[e])
        cover_b, cover_e = {b for b, _ in edges if ("b", b) not in reach}, {e for _, e in edges if ("e", e) in reach}
        assert all(b in cover_b or e in cover_e for b, e in edges) and len(cover_b) + len(cover_e) == len(mate)


def test_maximum_by_components(spark):
    """An island beyond the limit is matched by its components, with the pairs of the whole."""
    edges = [(100 * k + b, 100 * k + e, s) for k in range(6) for b, e, s in _graph(k, 8)]
    want = set(M.augmenting_pairs([(b, e) for b, e, _ in edges]))
    assert _set(M.match(_pairs(spark, edges), MAXFLOW, island_pairs=5)) == want
    placed = {(r["bank_idx"], r["gl_idx"]): r["island"] for r in M.components(_pairs(spark, edges)).collect()}
    assert len(placed) == len(edges)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for b, e, _ in edges:
        x, y = sorted((top(2 * b), top(2 * e + 1)))
        up[y] = x
    assert all(island == top(2 * b) for (b, _), island in placed.items())


def test_augmenting_path_beats_greedy():
    assert M.augmenting_pairs([(0, 0), (0, 1), (1, 0)]) == [(0, 1), (1, 0)]


def _pairs(spark, edges):
    rows = [(b, e, 10.0, 10.0, s) for b, e, s in edges]
    return spark.createDataFrame(rows, "bank_idx long, gl_idx long, bank_abs double, gl_abs double, score double")


def _set(df):
    return {(r["bank_idx"], r["gl_idx"]) for r in df.collect()}


def test_grouped_rounds_and_auto_equal_the_scan(spark):
    edges = _graph(4)
    want = _sequential(edges)
    pairs = _pairs(spark, edges)
    assert _set(M.match(pairs, GREEDY)) == want
    assert _set(M.match(pairs.repartition(3), GREEDY, "rounds")) == want
    assert _set(M.match(pairs, GREEDY, "auto", island_pairs=10)) == want
    assert len(_set(M.match(pairs, MAXFLOW))) >= len(want)


def test_no_pairs(spark):
    assert M.match(_pairs(spark, []), GREEDY).count() == 0
    assert M.match(_pairs(spark, []), GREEDY, "rounds").count() == 0


def _sides(spark):
    amounts = [1.0, 1.05, 1.1, 1.2, 100.0, 100.1, 50.0, -50.0, 0.0, 1e12, 1e12 + 0.1, float("inf"), float("nan"), None]
    day = lambda i: f"2024-01-{1 + i % 28:02d} 12:00:00"
    bank = [(i, day(i), a, "x y" if i % 3 else None) for i, a in enumerate(amounts * 3)]
    entry = [(i, day(i * 5), a, "x") for i, a in enumerate(amounts * 2)] + [(90, "2024-02-20 00:00:00", 1.0, "x")]
    shape = "idx long, ts string, amount double, description string"
    make = lambda rows, s, i: spark.createDataFrame(rows, shape).select(F.col("idx").alias(i), F.col("ts").cast("timestamp_ntz").alias(f"{s}_ts"), F.to_date("ts").alias(f"{s}_day"), F.col("amount").alias(f"{s}_amount"), F.col("description").alias(f"{s}_description"), F.array(F.lit("x")).alias(f"{s}_tokens"))
    return make(bank, "bank", "bank_idx"), make(entry, "gl", "gl_idx")


def test_bucketed_join_equals_the_naive_one(spark):
    bank, entry = _sides(spark)
    for config in (GREEDY, MAXFLOW):
        want = sorted(map(tuple, C.candidates_naive(bank, entry, config).collect()))
        assert sorted(map(tuple, C.candidates(bank, entry, config).collect())) == want
        assert sorted(map(tuple, C.candidates(bank, entry, config, day_buckets=True).collect())) == want
        assert want


def test_no_nested_loop_in_the_plan(spark):
    bank, entry = _sides(spark)
    plan = C.candidates(bank, entry, GREEDY)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_islands_by_window_and_by_sort(spark, monkeypatch):
    rows = [(i, i, a, a + 0.05, 1.0) for i, a in enumerate([0.0, 0.1, 0.3, 0.5, 5.0, 5.3, 9.0, 9.05, 100.0])]
    pairs = spark.createDataFrame(rows, "bank_idx long, gl_idx long, bank_abs double, gl_abs double, score double")
    by_island = lambda: sorted(sorted(r["x"]) for r in C.islands(pairs, GREEDY).groupBy("island").agg(F.collect_list("bank_idx").alias("x")).collect())
    want = by_island()
    assert len(want) > 3
    monkeypatch.setattr(C, "WINDOW_BUCKETS", 2)
    assert by_island() == want
