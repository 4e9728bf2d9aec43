import re
from collections import defaultdict

import numpy as np

from ledgerloom.llm import mixing as X


def test_knapsack_against_all_sums():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths, counts, budget = rng.choice(np.arange(1, 40), 5, replace=False), rng.integers(1, 5, 5), int(rng.integers(0, 150))
        sums = {0}
        for w, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + w * k for s in sums for k in range(c + 1)}
        taken = X.knapsack(lengths, counts, budget)
        assert sum(k * v for k, v in taken.items()) == max(s for s in sums if s <= budget)
        assert all(v <= dict(zip(lengths.tolist(), counts.tolist()))[k] for k, v in taken.items())


def test_few_long_texts_against_all_sums():
    rng = np.random.default_rng(3)
    cases = [([100_000, 60_000], [1, 1], 100_000), ([50_000, 50_001, 70_003], [3, 2, 4], 290_004), ([500, 3], [2_000, 1], 700_201)]
    cases += [(rng.choice(np.arange(20, 400), 4, replace=False) * 7 + 1, rng.integers(1, 5, 4), int(rng.integers(3_000, 9_000))) for _ in range(40)]
    for lengths, counts, target in cases:
        lengths, counts = np.array(lengths, np.int64), np.array(counts, np.int64)
        for reserve in (X.RESERVE, 50):
            copies, extra = X.fit(lengths, counts, float(target), reserve)
            assert (0 <= extra).all() and (extra <= counts).all()
            sums = {0}
            for w, c in zip(lengths.tolist(), counts.tolist()):
                sums = {s + w * k for s in sums for k in range(c + 1)}
            budget = min(target - copies * int((lengths * counts).sum()), int((lengths * counts).sum()))
            assert int((extra * lengths).sum()) == (max(s for s in sums if s <= budget) if copies < X.CAP else 0), (lengths, counts, target)


def _targets(sizes):
    """Water-filling, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, open_, target = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return target | share
        target.update({s: 3.0 * sizes[s] for s in full})
        open_ -= full
    return target


def test_mix(documents):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), [None, "a", "b", "é", "c"][int(rng.choice(5, p=[0.05, 0.6, 0.02, 0.03, 0.3]))]) for i in range(600)]
    rows += [(900, None, "a"), (901, " \n ", "zero"), (None, "x y z", "a"), (5, rows[5][1], "a")]
    got = X.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    assert sum(sizes.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    for s, target in _targets(sizes).items():
        assert all(abs(r["target"] - target) < 1e-6 and r["source_size"] == sizes[s] for r in got if r["source"] == s)
        assert abs(taken[s] - target) <= 1.5
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert key(X.mix(documents(rows, 7)).collect()) == key(got)


def test_no_rows(documents):
    assert X.mix(documents([])).count() == 0
    assert X.mix(documents([(1, "")])).first()["taken"] == 0
