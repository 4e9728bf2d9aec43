"""Personal data by weak supervision.

Four base kinds (email, ip, card, phone) are found by their patterns and stay.
Further kinds (secrets, social security and account numbers, names, local
phone numbers) are proposed by loose patterns and gazetteers. On every
candidate span five labelers vote -1, 0 or 1: strict pattern, checksum or
value range, gazetteer, words of the context, and borders. The corpus' vote
patterns are counted (a row for each kind and pattern at most), expectation
maximisation over the counts estimates the share of true spans by kind and how
reliable each labeler is, and a logistic classifier of spans is trained on the
posteriors: by kind, votes and the span's own shape (length, share of digits,
variety of characters), so that it weighs what no labeler votes on. Candidates
that it accepts and that overlap no base span are added.

Offsets are code points, ends exclusive. The patterns run in time linear in
the text. Defined results: null and empty texts have no spans; repeated rows
are scanned one by one; no documents, no rows. Columns beside doc_id and text may
have any name; long texts are scanned whole.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow

#: The base kinds in the order of the results, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "ssn", "iban", "person", "local_phone")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # a run of digits matches from its start or not at all
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SECRET = re.compile(
    r"""(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)['"]?[\x20\t]{0,3}[:=][\x20\t]{0,3}"""
    r"""(?:"((?:[^"\\\r\n]++|\\.)++)"|'((?:[^'\\\r\n]++|\\.)++)'|['"]?([^\s,;'"]+))"""  # to the closing quote of the line, or else one word
)
#: Beginnings of issued keys, which need no name before them.
_ISSUED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9])")
_MARKS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])")
#: Gazetteers.
NAMES = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Maria", "Hans", "Peter", "Klaus", "Ursula", "Pierre", "Jean", "Marie", "Sophie", "Carlos", "Jose", "Juan", "Carmen")
_PERSON = re.compile(rf"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr)\.? )?(?:{'|'.join(NAMES)}) [A-Z][a-z]+(?!\w)")
MAIL_ENDINGS = (".com", ".org", ".net", ".edu", ".gov", ".io", ".de", ".fr", ".es")
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25}
CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "pay", "credit"), "phone": ("phone", "tel", "call", "fax", "mobile"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key"), "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank"), "person": ("name", "mr", "mrs", "ms", "dr", "by", "dear"), "local_phone": ("phone", "tel", "call", "fax", "mobile"),
}
AGAINST = ("version", "isbn", "section", "page", "build", "release", "serial", "order")
_CUE_WORD = re.compile(r"[a-z]+")
VOTES = ("pattern", "checksum", "gazetteer", "context", "border")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(filter("0123456789".__contains__, s))


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start."""
    out = [("email", s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 16 <= len(m[0]) and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _mod97(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    if "=" in text or ":" in text:
        yield from (("secret", *m.span(m.lastindex)) for m in _SECRET.finditer(text))
    if any(mark in text for mark in _MARKS):
        yield from (("secret", m.start(), m.end()) for m in _ISSUED.finditer(text))
    if _DIGIT.search(text):
        if "-" in text:
            yield from (("ssn", m.start(), m.end()) for m in _SSN.finditer(text))
        yield from (("iban", m.start(), m.end()) for m in _IBAN.finditer(text))
        yield from (("local_phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text))
    yield from (("person", m.start(), m.end()) for m in _PERSON.finditer(text))


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """The labelers' votes on a span."""
    span, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 1]
    d = _digits(span)
    pattern = {"email": span.count(".") >= 1 and len(span) <= 254, "ip": all(len(p) <= 3 for p in span.split(".")), "card": True, "phone": 10 <= len(d) <= 15, "secret": len(span) >= 8, "ssn": not span.startswith(("000", "666", "9")), "iban": True, "person": True, "local_phone": len(d) == 10}[kind]
    checksum = {"card": lambda: luhn(d), "iban": lambda: _mod97(span), "ip": lambda: not span.startswith("0"), "secret": lambda: len(set(span)) >= 6 and bool(d), "ssn": lambda: span[4:6] != "00" and span[7:] != "0000", "local_phone": lambda: d[0] not in "01"}.get(kind)
    gazetteer = {"email": lambda: span.lower().endswith(MAIL_ENDINGS), "iban": lambda: IBAN_LENGTHS.get(span[:2]) == len(span), "person": lambda: span.split()[-2] in NAMES, "phone": lambda: d.startswith(("1", "33", "34", "49", "44"))}.get(kind)
    words = _CUE_WORD.findall(before)[-5:]
    context = 1 if any(w in CUES[kind] for w in words) else -1 if any(w in AGAINST for w in words) else 0
    border = -1 if before[-1:].isalnum() or after.isalnum() else 1
    sign = lambda f: 0 if f is None else 1 if f() else -1
    return 1 if pattern else -1, sign(checksum), sign(gazetteer), context, border


def shape(span: str) -> str:
    """Length, share of digits and number of different characters, a letter for each."""
    n = len(span)
    return "stml"[(n >= 8) + (n >= 16) + (n >= 32)] + "nfhd"[min(3, -(-3 * len(_digits(span)) // n))] + "xyz"[(len(set(span)) >= 6) + (len(set(span)) >= 12)]


def candidates(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, votes and shape) of every candidate span."""
    base = base_spans(text)
    out = [(k, s, e, True) for k, s, e in base]
    starts, ends = [], []  # what base spans cover, as runs that do not overlap
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for k, s, e in dict.fromkeys(_proposed(text)):
        at = bisect.bisect_left(starts, e) - 1
        if at < 0 or ends[at] <= s:
            out.append((k, s, e, False))
    return [(k, s, e, b, "".join("-0+"[v + 1] for v in votes(text, k, s, e)) + shape(text[s:e])) for k, s, e, b in out]


_SPAN = "struct<kind:string,start:long,end:long,base:boolean,votes:string>"
_ROW = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end", "base", "votes"), c)) for c in candidates(t.as_py() or "")] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(_ROW))], names=["doc_id", "spans"])


def reliabilities(counts: dict[tuple[str, str], int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, dict[tuple[str, str], float]]:
    """By expectation maximisation over (kind, votes) counts: the share of true
    spans by kind, P(vote | truth, it votes) by (truth, labeler, vote), and the
    posterior of each pattern, which starts from the votes' majority. An
    abstention (0) is no evidence."""
    keys = sorted(counts)
    if not keys:
        return {}, np.full((2, len(VOTES), 3), 0.5), {}
    n = np.array([counts[k] for k in keys], float)
    v = np.array([["-0+".index(c) for c in k[1][: len(VOTES)]] for k in keys]).reshape(len(keys), len(VOTES))
    kind = np.array([KINDS.index(k[0]) for k in keys], int)
    p = np.clip(0.5 + 0.12 * (v - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        share = (np.bincount(kind, n * p, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2)
        rely = np.ones((2, len(VOTES), 3))
        for truth, w in enumerate((n * (1 - p), n * p)):
            for k in range(len(VOTES)):
                # Prior counts say that a labeler is right rather than wrong, which fixes which class is "true".
                hits = np.bincount(v[:, k], w, 3) + np.array([[8, 0, 2], [2, 0, 8]][truth])
                rely[truth, k, [0, 2]] = hits[[0, 2]] / hits[[0, 2]].sum()
        log = [np.log(rely[truth, np.arange(len(VOTES)), v]).sum(axis=1) for truth in (0, 1)]
        odds = np.log(share[kind] / (1 - share[kind])) + log[1] - log[0]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(KINDS, share.tolist())), rely, dict(zip(keys, p.tolist()))


_SHAPES = "stmlnfhdxyz"


def _features(kind: str, pattern: str) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * len(VOTES) + len(_SHAPES))
    x[0] = x[1 + KINDS.index(kind)] = 1
    for c in pattern[len(VOTES) :]:
        x[1 + len(KINDS) + 2 * len(VOTES) + _SHAPES.index(c)] = 1
    for k, c in enumerate(pattern[: len(VOTES)]):
        x[1 + len(KINDS) + 2 * k] = c == "+"
        x[2 + len(KINDS) + 2 * k] = c == "-"
    return x


def train(counts: dict[tuple[str, str], int], steps: int = 60) -> np.ndarray:
    """Weights of the span classifier, by Newton steps on the patterns' posteriors."""
    posterior = reliabilities(counts)[2]
    w = np.zeros(1 + len(KINDS) + 2 * len(VOTES) + len(_SHAPES))
    if not counts:
        return w
    keys = sorted(counts)
    x, y, n = np.array([_features(*k) for k in keys]), np.array([posterior[k] for k in keys]), np.array([counts[k] for k in keys], float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 0.1 * w
        w -= np.linalg.solve((x.T * (n * np.maximum(p * (1 - p), 1e-4))) @ x + 0.1 * np.eye(len(w)), grad)
    return w


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every document."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.cut(arrow(texts, _candidates, f"doc_id long, spans array<{_SPAN}>"))
    patterns = rows.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["kind"], r["votes"]): r["n"] for r in patterns.collect()}  # a row for each kind, votes and shape at most, whatever the input
    w = train(counts)
    accepted = sorted(k for k in counts if k[0] in ADDED and 1 / (1 + np.exp(-float(_features(*k) @ w))) >= least)

    ranked = lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s.kind).alias("r"), s.start.alias("s"), s.end.alias("e"), s.kind.alias("k"))
    joined = lambda spans: F.array_join(F.transform(F.sort_array(F.transform(spans, ranked)), lambda s: F.concat_ws(":", s.k, s.s, s.e)), ",")
    good = F.array(*[F.lit(f"{k} {v}") for k, v in accepted]).cast("array<string>")
    base = F.filter("spans", lambda s: s.base)
    every = F.filter("spans", lambda s: s.base | F.array_contains(good, F.concat_ws(" ", s.kind, s.votes)))
    count = lambda k: F.size(F.filter("spans", lambda s: s.base & (s.kind == k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of spans in the order of the results."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
