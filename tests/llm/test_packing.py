import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import packing as X

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't <|endoftext|>x it's I'LL a<b É é éx\x85y\xa0z\x1cq ΣΑΣ ß İstanbul 12ab ́a ½ ª µm ''s 's' K", "", None, "  ", "a'b's", "### $$$ é,,é a1b2", "x" * 3000]


def test_ids_are_the_tokenizers():
    plain, own = Tokenizer.from_file(PATH), X.TokenIds(PATH)
    for text in ODD + ["Word, word; WORD! naïve façade 2024."]:
        assert own.encode(text) == np.array(plain.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_steps_place_every_piece_once():
    rng = np.random.default_rng(3)
    hist = {int(k): int(rng.integers(1, 50)) for k in rng.choice(np.arange(1, 65), 30, replace=False)}
    fill = {}
    for length, rank, count, first, offset in X.shortest_pack_first(hist, 64):
        for i in range(count):
            fill.setdefault(first + i, []).append((offset, length, rank + i))
    for parts in fill.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    ranks = sorted((length, r) for parts in fill.values() for _, length, r in parts)
    assert ranks == sorted((k, r) for k, n in hist.items() for r in range(n))


def test_round_trip(documents):
    plain = Tokenizer.from_file(PATH)
    rows = list(enumerate(ODD + [f"word{i} " * (i * 40) for i in range(60)] + ["same text"] * 40)) + [(None, "no id"), (3, "again")]
    got = X.pack(documents(rows), PATH).collect()
    ids = sorted((str(d), tuple(plain.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t in rows)
    assert sum(r["length"] for r in got) == sum(len(i) for _, i in ids)
    want = sorted((d, at, len(i[at : at + 2048]), zlib.crc32(np.array(i[at : at + 2048], "<u4").tobytes()), len(i)) for d, i in ids for at in range(0, len(i), 2048))
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
    assert len(used) <= -(-sum(used.values()) // 2048) + 1


def test_no_rows(documents):
    assert X.pack(documents([]), PATH).count() == 0
