"""Licence scans by a positional index of rare words, in DataFrame operations only.

Templates are short licence notices. Each word of a template has postings
(template, position). Words weigh by their inverse document frequency, counted
over all documents. Each template is looked up by the two heaviest words of its
mandatory key phrases, wherever they stand in a file: where both agree on one
relative position it is a candidate, and it counts if its key phrases stand at
that position. No place where they stand is missed, as they hold both words.
Its score is the share of its words' weight that the file has in place.

Three base phrases are found wherever their words stand consecutively.

Defined results: null and empty texts have no words, no labels and score 0;
repeated rows are scanned one by one; no documents, no rows; of templates that
weigh the same, and of several notices in a file, all give their labels. Columns
beside doc_id and text may have any name; long texts are scanned whole.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import let

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, notice, mandatory key phrases (words that stand in the notice as given).
TEMPLATES = [
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ["affero general public license", "version 3"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license", "version 2 0"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["endorse or promote products derived"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ["cc by sa 4 0"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "version 3"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
    ("artistic-2.0", "This program is licensed under the Artistic License 2.0.", ["artistic license 2 0"]),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0.", ["boost software license"]),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain under CC0 1.0 Universal.", ["cc0 1 0 universal"]),
    ("epl-2.0", "This program is made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    ("eupl-1.2", "Licensed under the European Union Public Licence, version 1.2", ["european union public licence"]),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", ["sil open font license"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ["in no event will the authors be held liable"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software"]),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words; upper-case letters count as letters, so a text need not be lower-cased to be split.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NOTICES = [re.findall(r"[a-z0-9]+", notice.lower()) for _, notice, _ in TEMPLATES]
VOCABULARY = sorted({w for words in _NOTICES for w in words})


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), lambda w: w != "")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def weights(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word, over all documents."""
    held = _texts(docs).select(F.array_intersect(_words(F.col("text")), _array(VOCABULARY)).alias("held"))
    counts = held.select(F.explode(F.concat(F.col("held"), F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = {r["w"]: r["n"] for r in counts.collect()}  # a row for each word of the vocabulary at most
    return {w: round(math.log((found.get("", 0) + 1) / (found.get(w, 0) + 1)) + 1e-3, 6) for w in VOCABULARY}


def _runs(words: Column, phrase: list[str]) -> Column:
    """Starts of a phrase's words in an array of words."""
    last = F.size(words) - len(phrase)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(phrase):
            ok &= F.get(words, i + k) == w
        return ok

    return F.filter(at, here)


def _mandatory(t: int) -> list[tuple[int, list[str]]]:
    """Where a template's key phrases start in its notice, and their words."""
    own, keys = _NOTICES[t], [phrase.split() for phrase in TEMPLATES[t][2]]
    return [(next(k for k in range(len(own)) if own[k : k + len(key)] == key), key) for key in keys]


def _index(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, position) of the two heaviest places of each template's key phrases, by word."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t in range(len(TEMPLATES)):
        places = {(start + k, w) for start, key in _mandatory(t) for k, w in enumerate(key)}
        for p, w in sorted(places, key=lambda x: (-idf[x[1]], x[1], x[0]))[:2]:
            out.setdefault(w, []).append((t, p))
    return out


def _aligned(words: Column, idf: dict[str, float]) -> Column:
    """array<struct<label, score>> of the templates that pass, from the positions of rare words."""
    postings = _index(idf)
    empty = F.array().cast("array<struct<t:int,at:int>>")

    def places(word: Column, i: Column) -> Column:
        out = empty
        for w, own in postings.items():
            out = F.when(word == w, F.array(*[F.struct(F.lit(t).alias("t"), (i - p).cast("int").alias("at")) for t, p in own])).otherwise(out)
        return out

    def checked(hit: Column) -> Column:
        out = F.lit(None).cast("struct<label:string,score:double>")
        for t, own in enumerate(_NOTICES):
            label = TEMPLATES[t][0]
            ok = hit.t == t
            for start, key in _mandatory(t):
                ok &= F.slice(words, F.greatest(hit.at + start, F.lit(0)) + 1, len(key)) == _array(key)
                ok &= hit.at + start >= 0
            total = sum(idf[w] for w in own)
            part = sum((F.when(F.get(words, hit.at + p) == w, F.lit(idf[w])).otherwise(F.lit(0.0)) for p, w in enumerate(own)), F.lit(0.0))
            out = F.when(ok, F.struct(F.lit(label).alias("label"), F.least(F.round(part / total, 6), F.lit(1.0)).alias("score"))).otherwise(out)
        return out

    def hits(held: Column) -> Column:
        return F.flatten(F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(held, w), places(w, i))), lambda x: x.isNotNull()))

    def candidates(own: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(own, lambda h, k: F.when(h == F.get(own, k + 1), h)), lambda h: h.isNotNull()))

    def scan(held: Column) -> Column:
        return let(F.sort_array(hits(held)), lambda own: F.filter(F.transform(candidates(own), checked), lambda x: x.isNotNull()))

    return let(F.array_intersect(words, _array(sorted(postings))), lambda held: F.when(F.size(held) > 0, scan(held)).otherwise(F.array().cast("array<struct<label:string,score:double>>")))


def _marks(idf: dict[str, float]) -> tuple[list[str], str]:
    """Words of which a text holds one at least, or else a match of the regex for
    the short words of "cc by", if it holds a base phrase or a template."""
    weight = lambda w: (len(w) > 3, idf.get(w, 0.0), len(w), w)
    needed = [p.split() for p in BASE if p != "cc by"] + [[w for p in phrases for w in p.split()] for _, _, phrases in TEMPLATES if not any("cc by" in p for p in phrases)]
    marks = {max(words, key=weight) for words in needed}
    return sorted(m for m in marks if not any(o != m and o in m for o in marks)), f"cc{_BETWEEN}by"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    Words are worked out for files that hold, in some letter case, a word that
    a base phrase or a template's key phrases need; the others can have neither.
    """
    idf = weights(docs)
    marks, cc = _marks(idf)
    open_ = let(F.lower("text"), lambda lower: functools.reduce(operator.or_, [F.contains(lower, F.lit(m)) for m in marks] + [F.contains(lower, F.lit("cc")) & lower.rlike(cc)]))
    words = F.when(open_, _words(F.col("text"))).otherwise(F.array().cast("array<string>"))

    def found(w: Column) -> Column:
        return F.struct(*[_runs(w, p.split()).alias(label.replace("-", "_")) for p, label in BASE.items()], _aligned(w, idf).alias("hits"))

    none = F.struct(*[F.array().cast("array<int>").alias(label.replace("-", "_")) for label in BASE.values()], F.array().cast("array<struct<label:string,score:double>>").alias("hits"))
    rows = _texts(docs).select("doc_id", F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"), let(words, lambda w: F.when(F.size(w) > 0, found(w)).otherwise(none)).alias("f"))
    runs = {label: F.col("f." + label.replace("-", "_")) for label in BASE.values()}
    starts = F.concat(*runs.values())
    base = F.concat(*[F.when(F.size(r) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for label, r in runs.items()])
    rows = rows.select("doc_id", "n_words", starts.alias("starts"), base.alias("base"), "f.hits")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("hits", lambda h: h.label))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h.score)), F.lit(0.0)).alias("score"),
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def sql() -> str:
    """The same in DuckDB SQL."""
    words = [(t, p, w) for t, own in enumerate(_NOTICES) for p, w in enumerate(own)]
    must = []
    for t, own in enumerate(_NOTICES):
        for phrase in TEMPLATES[t][2]:
            key = phrase.split()
            start = next(k for k in range(len(own)) if own[k : k + len(key)] == key)
            must += [x for k, w in enumerate(key) if (x := (t, start + k, w)) not in must]
    base = " UNION ALL ".join("SELECT a.doc_id, a.i, '" + label + "' AS label FROM w a " + " ".join(f"JOIN w x{k} ON x{k}.doc_id = a.doc_id AND x{k}.i = a.i + {k} AND x{k}.word = '{word}'" for k, word in enumerate(p.split())) for p, label in BASE.items())
    return rf"""
WITH t(t, p, word) AS (VALUES {_values(words)}), must(t, p, word) AS (VALUES {_values(must)}), name(t, label) AS (VALUES {_values([(t, x[0]) for t, x in enumerate(TEMPLATES)])}),
l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM l),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM w GROUP BY word),
idf AS (SELECT word, round(ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1)) + 1e-3, 6) AS weight FROM (SELECT DISTINCT word FROM t) LEFT JOIN df USING (word)),
ok AS (SELECT doc_id, m.t, w.i - m.p AS start FROM w JOIN (SELECT *, count(*) OVER (PARTITION BY t) AS need FROM must) m USING (word) GROUP BY ALL HAVING count(*) = any_value(need)),
total AS (SELECT t, sum(weight) AS total FROM t JOIN idf USING (word) GROUP BY t),
score AS (SELECT doc_id, max(part) AS score FROM (SELECT doc_id, o.t, o.start, least(round(sum(weight) / any_value(total), 6), 1.0) AS part FROM ok o JOIN t ON t.t = o.t JOIN total ON total.t = o.t JOIN w USING (doc_id) JOIN idf ON idf.word = t.word WHERE w.i = o.start + t.p AND w.word = t.word GROUP BY ALL) GROUP BY doc_id),
base AS ({base}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM ok JOIN name USING (t)) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM l LEFT JOIN b USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN score USING (doc_id)
"""
