import random
import re

from ledgerloom.llm import pii as X

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


TEXTS = ["a@b.c@d.e x..@y.z +1 22 333 4444 55", "a@@b.c 1.2.3.4.5.6.7.8 001.2.3.256 000255.1.1.1", "4111 1111 1111 1111-2 4111111111111111 +12345678901234567", "é@x.y @a.b éa@b.c", "mail jo@ex.com, password: hunter22xyz9", "@" * 50, "1" * 9000, "+1 " * 300, "", "Dear Mary Smith 078-05-1120"]


def test_base_spans_against_the_patterns():
    random.seed(8)
    for text in TEXTS + ["".join(random.choice("a1.@+- 49(") for _ in range(60)) for _ in range(3000)]:
        assert X.base_spans(text) == _base(text), text


def test_reliabilities_find_the_better_labelers():
    random.seed(9)
    counts = {}
    for _ in range(4000):
        truth = random.random() < 0.5
        vote = lambda right: "+" if truth == (random.random() < right) else "-"
        key = ("secret", "".join([vote(0.9), vote(0.8), vote(0.85), "0", vote(0.55)]))
        counts[key] = counts.get(key, 0) + 1
    _, rely, posterior = X.reliabilities(counts)
    assert [abs(rely[1, k, 2] - p) < 0.06 for k, p in ((0, 0.9), (1, 0.8), (2, 0.85), (4, 0.55))] == [True] * 4
    assert posterior[("secret", "+++0+")] > 0.9 > 0.1 > posterior[("secret", "---0-")]


def test_find(documents):
    rows = list(enumerate(TEXTS)) + [(50, None), (None, "x@y.org"), (3, TEXTS[3])]
    got = X.find(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t for d, t in rows if d == r["doc_id"]), "") or ""
        want = _base(text)
        assert [r[f"n_{k}"] for k in X.BASE] == [sum(s[0] == k for s in want) for k in X.BASE]
        assert r["base_sha256"] == X.digest(want)
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r["spans"].split(","))
    secret = next(r for r in got if r["doc_id"] == 4)["spans"]
    assert secret.split(",")[0].startswith("email:5:14") and "secret:" in secret
    assert X.find(documents([])).count() == 0


QUOTED = {
    'token = "04dbeb77a1c9"': "04dbeb77a1c9", "API_KEY: 'sk-93,fa;71\"e0'": "sk-93,fa;71\"e0", '{"user": "jo", "password": "hunter22xyz9"}': "hunter22xyz9", "{'api-key':'q1w2e3r4t5'}": "q1w2e3r4t5",
    'secret="ab\\"cd 12 ef"; x="y"': 'ab\\"cd 12 ef', 'pwd="9f8e7d6c5b\nnext': "9f8e7d6c5b", "passwd=plain77word, \"x\"": "plain77word", 'token = ""': None,
}


def test_quoted_secrets(documents):
    rows = list(enumerate(QUOTED))
    got = {r["doc_id"]: r["spans"] for r in X.find(documents(rows)).collect()}
    for d, text in rows:
        value = QUOTED[text]
        assert got[d] == ("" if value is None else f"secret:{text.index(value)}:{text.index(value) + len(value)}"), text


def test_planted_recall(spark):
    """Every planted secret, and each added kind, by the spans of whole tables."""
    import os

    import pytest

    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path).where("lower(text) like '%token = \"%'")
    want = {(r["doc_id"], m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer('(?i)token = "([0-9a-f]{40})"', r["text"])}
    got = {(r["doc_id"], int(s.split(":")[1]), int(s.split(":")[2])) for r in X.find(spark.read.parquet(path)).select("doc_id", "spans").collect() for s in r["spans"].split(",") if s.startswith("secret:")}
    assert len(want) > 100
    assert got == want


def test_added_kinds(documents):
    kinds = {"ssn": "my social security number is 123-45-6789 ok", "iban": "bank account DE89370400440532013000 here", "person": "Dear Mr. James Miller writes", "local_phone": "call (415) 555-2671 now", "secret": 'api_key: "Zx81kQp02LmN77vT"'}
    issued = "AKIA" + "A1B2C3D4E5F6G7H8"
    rows = [(i, t) for i, t in enumerate(kinds.values())] * 5 + [(50, f"see {issued} there"), (51, "plain words only, version 1.2.3 and order 555 1234")]
    got = {r["doc_id"]: r["spans"] for r in X.find(documents(rows)).collect()}
    for i, kind in enumerate(kinds):
        assert got[i].startswith(kind + ":"), (kind, got[i])
    assert got[50] == "secret:4:24" and got[51] == ""


def test_overlaps_are_linear():
    import time

    def took(n):
        text = " ".join(f"a{i}@mail.com token={i}abcdefgh" for i in range(n))
        began = time.process_time()
        assert len(X.candidates(text)) >= 2 * n
        return time.process_time() - began

    took(500)
    assert took(8000) < 10 * max(took(2000), 0.02)
