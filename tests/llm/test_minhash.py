import random

from ledgerloom.llm import minhash as M


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _brute(rows):
    """{doc_id: (set size, least doc_id reachable)} over all pairs."""
    sets, up = {d: _set(t) for d, t in rows}, {d: d for d, _ in rows}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def test_brute_force(documents):
    random.seed(5)
    words, rows = [f"w{i}" for i in range(400)], []
    for _ in range(9):
        base = [random.choice(words) for _ in range(random.randint(6, 160))]
        for _ in range(random.choice([1, 2, 3, 30, 90])):
            text = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3, 4, 6])):
                text[random.randrange(len(text))] = random.choice(words)
            rows.append(" ".join(text).upper() if random.random() < 0.2 else " ".join(text))
    rows += ["", "  \n ", "a b", "A  B", "one two three four", None, "é x" * 5000]
    random.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(documents(rows)).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in _brute(rows).items()}


def test_nulls_and_no_rows(documents):
    assert M.near_duplicates(documents([])).count() == 0
    got = M.near_duplicates(documents([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, None), (9, "A b c")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got if r["n_shingles"]) == [(-1, 4, True), (4, 4, True), (4, 4, True), (9, 4, False)]
