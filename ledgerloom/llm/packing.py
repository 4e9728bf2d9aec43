"""Shortest-pack-first packing of tokenised documents over the length histogram.

Krell et al., "Efficient Sequence Packing without Cross-contamination" (2021).
Documents are cut into pieces of at most ``SEQUENCE`` tokens; the histogram of
piece lengths (at most ``SEQUENCE`` rows, whatever the input) is packed on the
driver, longest length first, each into the emptiest packs that can hold it.
Packs of one layout are one row with a count, so a step places thousands of
pieces. Steps map the rank of a piece among those of its length to a sequence
and an offset; ranks come from salted windows, so a length that a third of all
pieces have is not one task.

Defined results: null and empty texts are documents of one token, the closing
id. Repeated rows are packed as documents of their own; pieces that agree in
all columns are interchangeable. No documents, no rows. Columns beside doc_id
and text may have any name; long texts are cut into as many pieces as they need.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, Scratch, arrow, salted_rank

SEQUENCE, END_ID = 2048, 1
#: Word parts whose ids a worker keeps at most, twice (about 28 MB).
CACHE = 120_000

_LETTERS = "a-zß-öø-ÿ"
#: A lower-cased text without these falls apart into letters, digits and other marks, whatever stands beside them: "'" begins contractions, "<" special tokens; the rest are letters, digits or blanks beyond Latin-1's plain ones.
_ODD = re.compile(r"['<\x1c-\x1f\x85\xa0ª²³µ¹º¼½¾\u0100-\U0010ffff]")
_PART = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\x20\x09-\x0d]+")


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters as byte-level tokenizers spell their UTF-8 bytes: printable
    bytes as themselves, the others as the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    spelled = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(256)}


_LETTER_BYTES = _byte_letters()


class TokenIds(Kept):
    """Little-endian 32-bit ids of word parts, kept once made.

    The tokenizer drops white space and never looks across it, so a text's ids
    are those of its words, and of plain words those of their parts. A plain
    part is in normal form, lower case and one piece already, so only its bytes
    are spelled out before the tokenizer's model merges them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(self._made, CACHE)
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def _made(self, part: str) -> bytes:
        if _ODD.search(part):
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.model.tokenize(part.translate(_LETTER_BYTES))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        lower = word.lower()
        return self[word] if _ODD.search(lower) else b"".join(map(self.__getitem__, _PART.findall(lower)))

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text."""
        lower = (text or "").lower()
        if not _ODD.search(lower):
            return b"".join(map(self.__getitem__, _PART.findall(lower)))
        return b"".join([self._word(w.decode("utf-8", "replace")) for w in text.encode("utf-8", "surrogatepass").split()])


_kept: list[TokenIds] = []


def token_ids(path: str) -> TokenIds:
    if not _kept or _kept[0].path != path:
        _kept[:] = [TokenIds(path)]
    return _kept[0]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: full ones from its start, then what is left."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = token_ids(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = ids_of.encode(text.as_py()) + end
                n = len(ids) // 4
                for at in range(0, n, sequence):
                    piece = ids[4 * at : 4 * (at + sequence)]
                    out.append((doc, at, len(piece) // 4, zlib.crc32(piece), n))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, count, first sequence, offset) that place all pieces.

    A group of packs of one layout is (first sequence, count), filed by the
    space its packs have left.
    """
    by_space: dict[int, list[tuple[int, int]]] = defaultdict(list)
    steps, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank, space = histogram[length], 0, sequence
        while left:
            while space >= length and not by_space[space]:
                space -= 1
            if space < length:  # no open pack can hold it
                by_space[sequence - length].append((sequences, left))
                steps.append((length, rank, left, sequences, 0))
                sequences += left
                break
            first, count = by_space[space].pop()
            take = min(count, left)
            if take < count:
                by_space[space].append((first + take, count - take))
            by_space[space - length].append((first, take))
            steps.append((length, rank, take, first, sequence - space))
            left, rank = left - take, rank + take
    return steps


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.cut(pieces(docs, tokenizer, sequence, end_id))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `sequence` rows
    by_length: dict[int, np.ndarray] = {}
    for length, *step in shortest_pack_first(histogram, sequence):
        by_length.setdefault(length, []).append(step)
    by_length = {k: np.array(v, np.int64) for k, v in by_length.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            ids, offsets = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                own, steps = np.flatnonzero(lengths == length), by_length[int(length)]
                step = steps[np.searchsorted(steps[:, 0], ranks[own], "right") - 1]
                ids[own], offsets[own] = step[:, 2] + ranks[own] - step[:, 0], step[:, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(ids), pa.array(offsets)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = salted_rank(cut, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"])
    return arrow(ranked, place, f"{PIECES}, sequence_id long, offset long")
