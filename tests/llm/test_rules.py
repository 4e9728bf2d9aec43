import random
import re
from collections import Counter

from ledgerloom.llm import rules as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _measure(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [s for s in (text or "").split("\n") if WORD.search(s)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures(documents):
    random.seed(7)
    words = ["a", "bb", "é", "d,", "#$", "x|y"]
    rows = [" ".join(random.choice(words) for _ in range(random.randint(0, 60))).replace("d, a", "d,\na") for _ in range(60)]
    rows += [None, "", " \t ", "Is " * 40, "one two three four five six seven eight " * 2, "a b\na b\n \n\na b", "\xa0\x85 x\x1cy", "z " * 9000]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r for r in X.judge(documents(rows)).collect()}
    for d, text in rows:
        r = got[d]
        want = _measure(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (d, text)
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_host_verdicts(documents):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(100)] + [(100 + i, good, "good") for i in range(300)] + [(500, good, None)]
    got = X.judge(documents(rows)).collect()
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert not any(verdict[i] for i in range(100))
    assert all(verdict[100 + i] for i in range(300)) and verdict[500]
    rate = {r["doc_id"]: r["host_rate"] for r in got}
    assert 0.5 < rate[0] <= 0.9 and rate[100] < 0.05 and rate[100] < rate[500] < rate[0]


def test_no_rows_and_nulls(documents):
    assert X.judge(documents([])).count() == 0
    assert [r["kept"] for r in X.judge(documents([(None, None, None), (1, None, None)])).collect()] == [False, False]
