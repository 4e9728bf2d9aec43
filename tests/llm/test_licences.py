import re

from ledgerloom.llm import licences as X

TEXTS = [
    None, "", "plain words only", "All rights reserved.", "ALL  RIGHTS\nRESERVED all rights reserved", "CC-BY and cc by-sa, cc\tby", "acc by", "cc bye",
    "x Licensed under the Apache License, Version 2.0. y", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 2.", "the license of apache version", "mit license", "word " * 5000 + "Licensed under CC BY-SA 4.0.", "général public license general public license",
]


def _base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = sorted((i, label) for p, label in X.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({f[1] for f in found}))


def test_base_and_labels(documents):
    rows = list(enumerate(TEXTS))
    got = {r["doc_id"]: r for r in X.scan(documents(rows)).collect()}
    for d, text in rows:
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _base(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {d: got[d]["labels"] for d, _ in rows}
    assert [labels[i] for i in (8, 9, 10, 11, 12, 13, 15)] == ["apache-2.0", "mit", "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "gpl,gpl-2.0", "", "cc-by,cc-by-sa-4.0"]
    assert got[11]["score"] == 1.0 and got[2]["score"] == 0.0


def test_no_rows(documents):
    assert X.scan(documents([])).count() == 0
    assert X.scan(documents([(None, None), (1, "cc by"), (1, "cc by")])).where("n_base = 1").count() == 2


def _labels(text):
    """Base labels, and those of all templates whose key phrases stand at their places, by trying every place."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    found = {label for p, label in X.BASE.items() if f" {p} " in f" {' '.join(words)} "}
    for (label, _, phrases), own in zip(X.TEMPLATES, X._NOTICES):
        keys = [(next(k for k in range(len(own)) if own[k : k + len(p.split())] == p.split()), p.split()) for p in phrases]
        if any(all(i + s >= 0 and words[i + s : i + s + len(k)] == k for s, k in keys) for i in range(-len(own), len(words))):
            found.add(label)
    return ",".join(sorted(found))


def test_every_notice_of_a_file(documents):
    notice = {label: text for label, text, _ in X.TEMPLATES}
    texts = [
        notice["agpl-3.0"] + " Released under the MIT License.", " ".join(notice[k] for k in ("apache-2.0", "mpl-2.0", "unlicense")), "\n\n".join(text for _, text, _ in X.TEMPLATES),
        "mozilla commons creative unencumbered endorse redistribution attribution affero lesser fee hereby " * 40 + "Released under the MIT License. " + "binary charge domain " * 300 + notice["gpl-2.0"],
        "mit license " * 9 + notice["apache-2.0"] + " version 2.0 apache license",
    ]
    rows = [*enumerate(texts), *((100 + i, "plain words license version") for i in range(20))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in X.scan(documents(rows)).collect()}
    assert [got[i][0] for i in range(len(texts))] == [_labels(t) for t in texts]
    assert got[0][0] == "agpl-3.0,gpl,mit" and got[1][0] == "apache-2.0,mpl-2.0,unlicense" and got[2][0].count(",") >= 14
    assert [got[i][1] for i in range(3)] == [1.0] * 3


def test_every_notice_in_one_text(documents):
    everything = " ".join(notice for _, notice, _ in X.TEMPLATES)
    stray = " ".join(X.VOCABULARY * 3)
    rows = [(1, everything), (2, f"{stray}. {everything} {stray} {everything}"), (3, stray), (4, "Apache License, Version 2.0; Mozilla Public License; Released under the MIT License."), (5, everything.upper())] + [(10 + k, f"{stray} {notice} {stray}") for k, (_, notice, _) in enumerate(X.TEMPLATES)]
    got = {r["doc_id"]: r for r in X.scan(documents(rows)).collect()}
    labels = {label for label, _, _ in X.TEMPLATES}
    for d in (1, 2, 5):
        assert labels <= set(got[d]["labels"].split(","))
    assert set(got[4]["labels"].split(",")) == {"apache-2.0", "mit", "mpl-2.0"}
    assert got[1]["score"] == 1.0
    for k, (label, _, _) in enumerate(X.TEMPLATES):
        assert label in got[10 + k]["labels"].split(",")


def test_sql_on_many_notices(spark, documents):
    import duckdb

    everything = " ".join(notice for _, notice, _ in X.TEMPLATES)
    rows = [(1, everything), (2, everything + " " + everything), (3, None), (4, "cc by-nc 4.0 cc by sa 4 0"), (5, "GNU General Public License, version 2 and the GNU General Public License, version 3")]
    docs = documents(rows)
    frame = docs.select("doc_id", "text").toPandas()
    c = duckdb.connect()
    c.register("documents", frame)
    want = {r[0]: r[1:] for r in c.sql(X.sql()).fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in X.scan(docs).collect()}
    assert got == want
