"""Exact repeats by sorting suffixes: deep-shallow sorting on sampled anchors.

Texts are UTF-8 bytes. A byte goes if a ``LENGTH``-byte string that covers it
also starts earlier (smaller doc_id, or same document and earlier); strings are
judged on the input and never cross documents.

Sampling. In every window of ``LENGTH`` bytes the ``GRAM``-byte string with the
least hash is the window's minimiser, so equal windows have equal minimisers.
Runs of windows with one minimiser form a segment (its windows' bytes). A
segment whose minimiser occurs once in the corpus cannot repeat and goes no
further; that is decided on hashes alone, with one entry for each hash and
batch of documents, so a frequent string does not fill one task.

Sorting. The other segments meet by minimiser, equal ones once per batch.
Within a minimiser, the texts after the anchors (suffixes) and, read
backwards, those before it are sorted: by multikey quicksort, eight bytes a
character and all groups at once, to a depth of ``SHALLOW`` bytes, then a blind
trie for each group with a longer common prefix, which looks at the bytes where
its branches part and compares with one leaf. Neighbours' common prefixes then tell for every window offset
which windows are equal, and all but the earliest go.

Periodic text has an anchor every few bytes. Its windows that equal the window
one period before them are repeats at once, and only the others are sorted.

A minimiser with over ``HOT`` segments is dealt by a salt; its tasks hand on
one window per class, and the classes meet once more by a 128-bit hash.

Defined results: null and empty texts have no bytes; rows without a doc_id
lose nothing and are nobody's source; rows that share a doc_id count as one
document, what goes from one goes from all; an empty table gives no rows.
Columns beside doc_id and text may have any name; a long text is worked on by
the megabyte, and all of it counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow, bounded, bytes_read

LENGTH, GRAM, SHALLOW, HOT = 100, 16, 32, 50_000
REACH = LENGTH - GRAM  # an anchor starts at most so far into its window
#: Bytes of segments that a part should hold, and of documents that one blob covers at most.
PART, BATCH_BYTES = 16_000_000, 8_000_000
_U = np.uint64
_LOW = _U((1 << 32) - 1)
#: Windows from which a segment is looked through for periods, and how many periods are tried.
FOLD, PERIODS = 4 * LENGTH, 3
#: Bytes of a text, and of segments, that are worked on at once.
_BLOCK, _SOLVE = 1 << 20, 1 << 21


def _grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    h = b.astype(_U) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    width = 1
    while width < GRAM:
        h = h[:-width] * _U(0xBF58476D1CE4E5B9) + (h[width:] ^ (h[width:] >> _U(31))) * _U(0x94D049BB133111EB)
        width *= 2
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    at = 1
    while at * 2 <= width:
        x = np.minimum(x[:-at], x[at:])
        at *= 2
    return np.minimum(x[: len(x) - (width - at)], x[width - at :]) if at < width else x


def _places(b: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The place of each window's minimiser, the leftmost of equal ones; below 2^32 bytes."""
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=_U)
    return (_least(keys, REACH + 1) & _LOW).astype(np.int64)


def segments(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: its hash, the first window, how many
    windows, and whether the minimiser's place changes in the run (it may repeat itself)."""
    found = []
    for at in range(0, len(b) - LENGTH + 1, _BLOCK):
        x = np.frombuffer(b, np.uint8)[at : at + _BLOCK + LENGTH - 1]
        grams = _grams(x)
        place = _places(x, grams)
        least = grams[place]
        moved = place[1:] != place[:-1]
        edge = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        moves = np.add.reduceat(np.concatenate([[0], moved]).astype(np.int64), edge)
        # The move into a run is counted in it.
        found.append((least[edge], at + edge, np.diff(edge, append=len(place)), moves > (edge > 0)))
    if not found:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def _batches(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[list[tuple]]:
    """Rows, some megabytes of their texts at a time."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c) for c in batch.schema.names)):
            rows.append(tuple(x.as_py() for x in row))
            held += len(rows[-1][1] or "")
            if held >= size:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.astype(np.int64).tobytes() for a in arrays), 3)


def _unpack(blob: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.int64).reshape(columns, -1)


def _anchors(parts: int):
    """Blobs of (hash, doc, first, count): by hash, the segments whose hash the batch
    has once (kind 0) and a marker for each other hash (kind 1), whose segments are
    known to repeat, or may repeat themselves, and go on from anywhere (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches):
            found = [(d, *segments((t or "").encode("utf-8", "surrogatepass"))) for d, t in rows]
            h = np.concatenate([f[1] for f in found])
            doc, first, count = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64), np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
            itself = np.concatenate([f[4] for f in found])
            order = np.argsort(h, kind="stable")
            h, doc, first, count = h[order], doc[order], first[order], count[order]
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            known = again | itself[order]
            known[:-1] |= again[1:]
            lead = known & ~again
            out = []
            for mask, kind in ((~known, 0), (lead, 1), (known, 2)):
                key = (h[mask] % _U(parts)).astype(np.int64) if kind < 2 else doc[mask] % parts
                by = np.argsort(key, kind="stable")
                cols = [x[mask][by] for x in (h.view(np.int64), doc, first, count)]
                edges = np.searchsorted(key[by], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    a, z = edges[p], edges[p + 1]
                    out.append((int(p), kind, _pack(*(c[a:z] for c in cols))))
            c = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary())], names=["part", "kind", "blob"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of the task's parts whose hash occurs again anywhere."""

    def rows(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["h", "doc", "first", "count"])

    single, marks = [], []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
            x = _unpack(blob, 4)
            if kind == 2:
                yield rows(x)
            elif kind == 1:
                marks.append(x[0])
            else:
                single.append(x)
    if single:
        x = np.concatenate(single, axis=1)
        values, counts = np.unique(x[0], return_counts=True)
        again = np.union1d(values[counts > 1], np.concatenate(marks) if marks else values[:0])
        yield rows(x[:, np.isin(x[0], again)])


def folded(piece: bytes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs (first, count) of a segment's windows: those to be sorted, and those that
    equal the window one period before them, for its most common distances of anchors."""
    count = len(piece) - LENGTH + 1
    if count < FOLD:
        return [(0, count)], []
    x = np.frombuffer(piece, np.uint8)
    steps, often = np.unique(np.diff(np.unique(_places(x, _grams(x)))), return_counts=True)
    again = np.zeros(count, bool)
    for p in steps[np.argsort(-often, kind="stable")][:PERIODS].tolist():
        same = np.cumsum(np.concatenate([[0], x[p:] == x[:-p]]))
        again[p:] |= same[LENGTH:] - same[:-LENGTH] == LENGTH
    edge = np.flatnonzero(np.diff(again)) + 1
    runs = list(zip([0, *edge.tolist()], [*edge.tolist(), count]))
    return [(a, z - a) for a, z in runs if not again[a]], [(a, z - a) for a, z in runs if again[a]]


def _cut(parts: int):
    """Blobs of segments (hash and salt, doc, first, count, text) by part. Equal
    segments of a batch go on once; the later ones' windows are repeats at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches):
            texts, meta, spans, seen = [], [], [], {}
            for doc, text, found in sorted(((d, t, s) for d, t, s in rows if s), key=lambda r: r[0]):
                b = text.encode("utf-8", "surrogatepass")
                for s in sorted(found, key=lambda s: s["first"]):
                    piece = b[s["first"] : s["first"] + s["count"] + LENGTH - 1]
                    if len(piece) < s["count"] + LENGTH - 1:
                        continue  # of another row with this doc_id
                    if seen.setdefault(piece, (doc, s["first"])) == (doc, s["first"]):
                        part = (s["h"] ^ s["salt"] * 0x9E3779B1) % parts
                        sort, again = folded(piece)
                        meta += [(part, s["h"], s["salt"], doc, s["first"] + a, n) for a, n in sort]
                        texts += [piece[a : a + n + LENGTH - 1] for a, n in sort]
                        spans += [(doc, s["first"] + a, s["first"] + a + n + LENGTH - 1) for a, n in again]
                    else:
                        spans.append((doc, s["first"], s["first"] + len(piece)))
            out = []
            if meta:
                m = np.array(meta, np.int64)
                by = np.argsort(m[:, 0], kind="stable")
                edges = np.searchsorted(m[by, 0], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    own = by[edges[p] : edges[p + 1]]
                    out.append((int(p), _pack(*m[own, 1:].T), zstandard.compress(b"".join([texts[i] for i in own]), 3)))
            if spans:
                out.append((spans[0][0] % parts, _pack(*np.array(spans).T), None))
            c = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary())], names=["part", "meta", "texts"])

    return run


class _Trie:
    """A blind trie over strings with a common prefix: inner nodes know the
    depth at which their children part, edges one byte; the bytes between are
    not looked at on the way down."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0  # a leaf, or [depth, {byte: child}]
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, strings = self.strings[i], self.strings
        node = self.root
        while type(node) is list:
            child = node[1].get(s[node[0]])
            if child is None:
                child = next(iter(node[1].values()))
            node = child
        leaf = strings[node]
        # The first byte that differs from the leaf found, then down again to where it parts.
        low, high = 0, len(s)
        while low < high:
            mid = (low + high) // 2
            if s[low : mid + 1] == leaf[low : mid + 1]:
                low = mid + 1
            else:
                high = mid
        depth, above, node = low, None, self.root
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if type(node) is list and node[0] == depth:
            node[1][s[depth]] = i
            return
        new = [depth, {leaf[depth]: node, s[depth]: i}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack.extend(child for _, child in sorted(node[1].items(), key=lambda x: -x[0]))
            else:
                out.append(node)
        return out


def multikey_quicksort(group: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings (columns of keys, a row for each character) within groups, and
    whether each one but the first equals the one before it in all characters.

    Bentley and Sedgewick's three-way partition, on all parts of all groups in
    one step: strings below, at and above their part's pivot become parts of
    their own, and those at the pivot go on with the next character. Ties stay
    in the order given.
    """
    depths, n = keys.shape
    order = np.argsort(group, kind="stable")
    begins = np.concatenate([[True], group[order][1:] != group[order][:-1]])  # where parts begin
    depth = np.zeros(n, np.int8)  # by place: characters that the part's strings share
    live = np.arange(n)
    while True:
        part = np.cumsum(begins[live]) - 1
        sizes = np.bincount(part)
        keep = (sizes[part] > 1) & (depth[live] < depths)
        live = live[keep]
        if not len(live):
            break
        starts = np.flatnonzero(begins[live])
        sizes = np.diff(starts, append=len(live))
        part = np.repeat(np.arange(len(starts)), sizes)
        at = order[live]
        key = keys[depth[live], at]
        low, mid, high = key[starts], key[starts + sizes // 2], key[starts + sizes - 1]
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))[part]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        to = np.empty(len(live), np.int64)
        counts = np.bincount(3 * part + side, minlength=3 * len(starts))
        ahead = np.cumsum(counts) - counts
        for s in range(3):
            own = np.flatnonzero(side == s)
            first = ahead[3 * part[own] + s]
            to[own] = first + np.arange(len(own)) - np.searchsorted(part[own], part[own], "left")
        order[live[to]] = at
        deeper = depth[live] + (side == 1)
        depth[live[to]] = deeper
        begins[live[ahead[counts > 0]]] = True
    return order, ~begins[1:]


def deep_shallow(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long strings (rows of bytes) within groups, and each one's
    common prefix with the one before it in that order (-1 where a group begins)."""
    n, width = rows.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shallow = min(SHALLOW, width) // 8 * 8
    order, same = multikey_quicksort(group, np.stack([np.ascontiguousarray(rows[:, k : k + 8]).view(">u8").ravel().astype(_U) for k in range(0, shallow, 8)]))
    # Groups that agree to the shallow depth go to blind tries, equal strings as one.
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    sizes = np.diff(starts, append=n)
    for s, m in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        own = order[s : s + m]
        alike: dict[bytes, list[int]] = {}
        for i in own.tolist():
            alike.setdefault(rows[i].tobytes(), []).append(i)
        if len(alike) > 1:
            strings = list(alike)
            order[s : s + m] = [i for k in _Trie(strings).order() for i in alike[strings[k]]]
    differ = rows[order][1:] != rows[order][:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], common])


def _windows(text: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members: runs of windows with one anchor place. Segment, first window and anchor (both places in text), in order; the count follows from the next."""
    place = _places(text, _grams(text))
    windows = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    segment = np.repeat(np.arange(len(starts)), counts)
    at = place[windows]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (segment[1:] != segment[:-1])])
    return segment[new], windows[new], at[new], np.diff(np.flatnonzero(new), append=len(windows))


def _solve(meta: np.ndarray, text: np.ndarray) -> Iterator[np.ndarray]:
    """Columns (doc, start, end, f1, f2) from distinct segments: spans that repeat
    (f1 = f2 = 0), and for salted minimisers one window of each class with its hash."""
    h, salt, doc, first, count = meta
    ends = np.cumsum(count + LENGTH - 1)
    starts = ends - (count + LENGTH - 1)
    segment, window, anchor, windows = _windows(text, starts, count)
    # Members in the order in which they start, so the least index of a class is its earliest.
    begin = first[segment] + window - starts[segment]
    by = np.lexsort((begin, doc[segment]))
    segment, window, anchor, windows, begin = (x[by] for x in (segment, window, anchor, windows, begin))
    own = doc[segment]
    gram = np.unique(np.stack([h[segment], salt[segment]]), axis=1, return_inverse=True)[1].ravel()
    padded = np.concatenate([np.zeros(REACH, np.uint8), text, np.zeros(LENGTH, np.uint8)])
    after = padded[anchor[:, None] + REACH + np.arange(LENGTH)]
    before = padded[anchor[:, None] + REACH - 1 - np.arange(REACH)]
    # Bytes of other segments never count: a window's own bytes are compared only to its depth.
    r_order, r_common = deep_shallow(gram, after)
    l_order, l_common = deep_shallow(gram, before)
    least, most = anchor - window - windows + 1, anchor - window  # offsets of the anchor in the member's windows
    repeats = np.zeros((len(by), REACH + 1), bool)
    r_run, l_run = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    heads: list[tuple[np.ndarray, np.ndarray]] = []
    salted = salt[segment] >= 0
    for j in range(REACH + 1):
        active = np.flatnonzero((least <= j) & (j <= most))
        if not len(active):
            continue
        r_run[r_order] = np.cumsum(r_common < LENGTH - j)
        l_run[l_order] = np.cumsum(l_common < j)
        key = r_run[active] * (len(by) + 1) + l_run[active]
        _, head, which = np.unique(key, return_index=True, return_inverse=True)
        head = active[head][which.ravel()]
        start, origin = begin[active] + most[active] - j, begin[head] + most[head] - j
        repeats[active, j] = (own[active] != own[head]) | (start != origin)
        lead = active[(head == active) & salted[active]]
        if len(lead):
            heads.append((lead, np.full(len(lead), j)))
    # Runs of offsets as spans of bytes: the window with offset j starts at anchor - j.
    edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    who, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    origin = begin[who] + most[who]
    zero = np.zeros(len(who), np.int64)
    yield np.stack([own[who], origin - high, origin - low + LENGTH, zero, zero])
    if heads:
        lead, j = (np.concatenate(x) for x in zip(*heads))
        place = anchor[lead] - j
        f = np.array([np.frombuffer(xxhash.xxh3_128_digest(text[p : p + LENGTH].tobytes()), np.int64) for p in place.tolist()]).reshape(-1, 2)
        start = begin[lead] + most[lead] - j
        yield np.stack([own[lead], start, start + LENGTH, f[:, 0], f[:, 1] | 1])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the parts of a task, one part after the other."""

    def rows(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["doc", "s", "e", "f1", "f2"])

    part, meta, texts = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        if meta:
            m = np.concatenate(meta, axis=1)
            sizes = m[4] + LENGTH - 1
            joined = b"".join(texts)
            ends = np.cumsum(sizes)
            # The same segment may come from several batches: one stays, the earliest.
            order = np.lexsort((m[3], m[2]))
            seen: dict[tuple, tuple] = {}
            keep, spans = [], []
            for i in order.tolist():
                piece = joined[ends[i] - sizes[i] : ends[i]]
                place = (m[2, i], m[3, i])
                held = seen.setdefault((piece, m[1, i]), place)
                if held is place:
                    keep.append(i)
                elif held != place:
                    spans.append((m[2, i], m[3, i], m[3, i] + sizes[i], 0, 0))
            if spans:
                yield rows(np.array(spans, np.int64).T)
            # Some megabytes of segments at a time; a minimiser stays whole.
            keep = np.array(keep)[np.argsort(m[0, keep], kind="stable")]
            bounds = np.flatnonzero(np.diff(m[0, keep])) + 1
            at = 0
            while at < len(keep):
                total = np.cumsum(sizes[keep[at:]])
                fit = at + int(np.searchsorted(total, _SOLVE, "right"))
                later = bounds[bounds > at]
                to = int(next(iter([*later[later <= fit][-1:], *later[:1]]), len(keep))) if fit < len(keep) else len(keep)
                own = keep[at:to]
                pieces = b"".join([joined[ends[i] - sizes[i] : ends[i]] for i in own.tolist()])
                for x in _solve(m[:, own], np.frombuffer(pieces, np.uint8)):
                    yield rows(x)
                at = to

    for batch in batches:
        for p, blob, text in zip(batch.column("part").to_pylist(), batch.column("meta").to_pylist(), batch.column("texts").to_pylist()):
            if text is None:
                x = _unpack(blob, 3)
                yield rows(np.concatenate([x, np.zeros((2, x.shape[1]), np.int64)]))
                continue
            if p != part:
                yield from done()
                part, meta, texts = p, [], []
            meta.append(_unpack(blob, 5))
            texts.append(zstandard.decompress(text))
    yield from done()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist()):
            b = (text.as_py() or "").encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for x in sorted((x["s"], x["e"]) for x in spans or ()):
                s, e = x[0], min(x[1], len(b))
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                elif s < e:
                    runs.append([s, e])
            kept, at = hashlib.sha256(), 0
            for s, e in runs:
                kept.update(b[at:s])
                at = e
            kept.update(b[at:])
            out.append((doc, len(b), sum(e - s for s, e in runs), len(runs), kept.hexdigest(), [{"s": s, "e": e} for s, e in runs]))
        c = list(zip(*out)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeats(docs: DataFrame, hot: int = HOT, per_part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # Parts hold some megabytes whatever the input: its stored bytes tell how many there are.
    shuffled = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * (bytes_read(docs.select("doc_id", "text")) or 0) // PART))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    named = texts.where("doc is not null")
    blobs = arrow(named, _anchors(shuffled), "part int, kind int, blob binary")
    again = scratch.cut(arrow(blobs.repartition(shuffled, "part"), _repeated, "h long, doc long, first long, count long"))
    total = again.agg(F.sum(F.col("count") + LENGTH - 1).alias("n")).first()["n"] or 0
    parts = max(shuffled, -(-total // per_part))

    crowded = again.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("h", F.ceil(F.col("n") / hot).cast("int").alias("salts"))
    salt = F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc", "first"), F.col("salts"))).cast("long")
    salted = again.join(bounded(scratch.cut(crowded)), "h", "left").select("doc", F.struct("h", "first", "count", salt.alias("salt")).alias("s"))
    of_doc = salted.groupBy("doc").agg(F.collect_list("s").alias("segments"))
    by_doc = texts.repartition(shuffled, "doc")
    pieces = arrow(by_doc.join(of_doc, "doc").select("doc", "text", "segments"), _cut(parts), "part int, meta binary, texts binary")
    spans = scratch.cut(arrow(pieces.repartition(max(shuffled, parts), "part").sortWithinPartitions("part"), _repeats, "doc long, s long, e long, f1 long, f2 long"))

    classes = spans.where("f2 <> 0")
    earliest = classes.groupBy("f1", "f2").agg(F.min(F.struct("doc", "s")).alias("m"))
    late = classes.join(earliest, ["f1", "f2"]).where(F.struct("doc", "s") != F.col("m")).select("doc", "s", "e")
    every = spans.where("f2 = 0").select("doc", "s", "e").union(late)
    gone = every.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = by_doc.join(gone, "doc", "left").select(F.col("doc").alias("doc_id"), "text", "spans")
    return arrow(joined, _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:long,e:long>>")
