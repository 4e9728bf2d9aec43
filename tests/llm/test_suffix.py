import hashlib
import random

import numpy as np

from ledgerloom.llm import suffix as X


def _brute(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def _rows():
    random.seed(3)
    words = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 6))) for _ in range(60)]
    base = [" ".join(random.choice(words) for _ in range(random.randint(10, 120))) for _ in range(20)]
    rows = [None, "", "x" * 99, "x" * 100, "x" * 101, "a\0" * 90, "y" * 5000]
    for _ in range(110):
        text = random.choice(base)
        if random.random() < 0.7:
            text = text.split()
            text[random.randrange(len(text))] = "zz"
            text = " ".join(text)
        if random.random() < 0.3:
            text += " " + random.choice(base)
        rows.append("Is " * random.randint(40, 300) if random.random() < 0.1 else text)
    return list(enumerate(rows))


def _run(docs, **k):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in X.repeats(docs, **k).collect()}


def test_brute_force(documents):
    rows = _rows()
    want = _brute(rows)
    assert _run(documents(rows)) == want
    # Every minimiser salted, many parts.
    assert _run(documents(rows, 5), hot=3, per_part=3000) == want


def test_nulls_and_no_rows(documents):
    assert X.repeats(documents([])).count() == 0
    got = [tuple(r)[:4] for r in X.repeats(documents([(None, "q" * 50 + "r" * 100), (None, "q" * 50 + "r" * 100), (3, "q" * 50 + "r" * 100), (3, "q" * 50 + "r" * 100)])).collect()]
    assert sorted(got, key=str) == sorted([(None, 150, 0, 0)] * 2 + [(3, 150, 0, 0)] * 2, key=str)


def test_deep_shallow_sorts():
    random.seed(4)
    rows = []
    for _ in range(300):
        rows.append(bytes(random.choice(b"ab") if random.random() < 0.05 else 97 for _ in range(100)))
    group = np.array([random.randint(0, 2) for _ in rows])
    order, common = X.deep_shallow(group, np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 100))
    keys = [(group[i], rows[i]) for i in order]
    assert keys == sorted(keys)
    for k in range(1, len(order)):
        (g, a), (h, b) = keys[k - 1], keys[k]
        assert common[k] == (-1 if g != h else next((i for i in range(100) if a[i] != b[i]), 100))


def test_multikey_quicksort_is_a_stable_sort():
    rng = np.random.default_rng(6)
    for n, span in ((0, 5), (1, 5), (700, 2), (900, 40), (300, 2**40)):
        group, keys = rng.integers(0, 9, n), rng.integers(0, span, (4, n)).astype(np.uint64)
        order, same = X.multikey_quicksort(group, keys)
        assert order.tolist() == np.lexsort((*keys[::-1], group)).tolist()
        whole = [(group[i], *keys[:, i]) for i in order]
        assert same.tolist() == [a == b for a, b in zip(whole, whole[1:])]


def test_periods_are_folded():
    for unit in (b"x", b"ab", b"0123456789" * 3):
        piece = unit * (400_000 // len(unit))
        sort, again = X.folded(piece)
        assert sum(n for _, n in sort) <= 4 * len(unit) + 100 and sum(n for _, n in sort + again) == len(piece) - 99


def test_texts_beyond_a_block(documents):
    """Texts over 1 MiB, whose segments are over 2 MiB together: of one byte, periodic, and with a passage again."""
    random.seed(11)
    prose = "".join(random.choice("abcdefghij klm") for _ in range(X._BLOCK + 200_000))
    rows = [(0, "z" * (X._BLOCK + 300_000)), (1, prose), (2, "ab" * 300_000 + prose[500_000:1_200_000] + "z" * 500), (3, prose[:50] + "new " * 10 + prose[X._BLOCK - 5000 : X._BLOCK + 5000])]
    seen: set[int] = set()
    want = {}
    for doc, text in rows:
        b, gone = text.encode(), bytearray(len(text))
        for i in range(len(b) - 99):
            w = hash(b[i : i + 100])
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[doc] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    assert _run(documents(rows)) == want
