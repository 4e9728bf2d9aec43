import random

from ledgerloom.llm import lines as X


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def _brute(rows, least=1):
    """Texts without the lines that an earlier one repeats, by comparing all pairs."""
    places = [(d, k, line.lower().split()) for d, t in sorted(rows) for k, line in enumerate((t or "").split("\n"))]
    gone = {
        (d, k)
        for i, (d, k, a) in enumerate(places)
        if len(a) >= least and any(a == b or (min(len(a), len(b)) >= 10 and abs(len(a) - len(b)) <= 1 and _distance(a, b) <= 1) for _, _, b in places[:i])
    }
    return {d: (None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in rows}


def test_brute_force(documents):
    random.seed(6)
    words = [f"w{i}" for i in range(30)] + ["é"]
    base = [[random.choice(words) for _ in range(random.randint(3, 24))] for _ in range(25)]
    base += [["x"] * 11, ["x"] * 12, ["x"] * 13]

    def line():
        own = list(random.choice(base))
        for _ in range(random.choice([0, 0, 0, 1, 1, 2])):
            at = random.randrange(len(own))
            own = random.choice([own[:at] + own[at + 1 :], own[:at] + [random.choice(words)] + own[at:], own[:at] + [random.choice(words)] + own[at + 1 :]]) or ["q"]
        text = "  ".join(own)
        return text.upper() if random.random() < 0.2 else text

    rows = [(i, "\n".join(line() for _ in range(random.randint(1, 6)))) for i in range(70)] + [(100, None), (101, ""), (102, "\n\n"), (103, "a b\r\n" * 3), (104, "long " * 4000)]
    got = {r["doc_id"]: r["text"] for r in X.dedup_lines(documents(rows)).collect()}
    want = _brute(rows)
    assert got == want
    assert any(want[d] != t for d, t in rows)
    spared = {r["doc_id"]: r["text"] for r in X.dedup_lines(documents(rows), least_words=5).collect()}
    assert spared == _brute(rows, 5) != want


def test_short_lines_go_if_equal_and_blank_ones_stay(documents):
    rows = [(1, "Home\n\nRead more\n}"), (2, "home\n \nread  more\nRead most\n}"), (3, "Home"), (4, "\n\n")]
    got = {r["doc_id"]: r["text"] for r in X.dedup_lines(documents(rows)).collect()}
    assert got == {1: rows[0][1], 2: " \nRead most", 3: "", 4: "\n\n"}


def test_nulls_repeats_and_no_rows(documents):
    line = "one two three four five six"
    out = X.dedup_lines(documents([(None, line), (2, line), (2, line), (3, "x\n" + line)]))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    got = sorted((str(r["doc_id"]), r["text"], r["_line_dedup"]["n_removed"]) for r in out.collect())
    assert got == [("2", line, 0), ("2", line, 0), ("3", "x", 1), ("None", "", 1)]
    assert X.dedup_lines(documents([])).count() == 0
