import random

from ledgerloom.llm.common import Scratch, salted_rank
from ledgerloom.llm.components import connected_components


def test_chain_star_and_random(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(random.randint(300, 420), random.randint(300, 420)) for _ in range(70)] + [(7, 7), (8, None)]
    up = {x: x for e in edges for x in e if x is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def test_salted_rank(spark):
    rows = [(None if i % 3 == 0 else "a", i % 2, i // 2) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, s int, x int")
    got = salted_rank(df, ["k", "s"], ["x"], salts=8).collect()
    for k in (None, "a"):
        for s in (0, 1):
            own = sorted(r["rank"] for r in got if r["k"] == k and r["s"] == s)
            assert own == list(range(len(own)))
    assert len(got) == 200
