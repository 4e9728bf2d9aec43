"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line (``\\n``-split) with a word goes if an earlier line of the corpus (smaller
doc_id, or same document and earlier) is the same, or, where both have
``EDIT_WORDS`` words or more, is one word edit away: a word inserted, deleted or
replaced. One edit in ten words is the bound; shorter lines allow none. Words
are compared without case and blanks. ``least_words`` spares shorter lines.

Equal lines collapse into classes that know their earliest place. One edit
leaves one of a line's halves whole, so only classes that share a half with
another class go on. Each emits the hashed keys of all its variants: itself,
and itself less its i-th word. Lines one replacement apart share the variant
and i; lines one insertion apart share a variant with the whole shorter line.
Every key hands back its earliest place, so nothing is paired within a key;
the one line found is then compared word by word, and the later line goes.

Whether a line goes is judged on the input, not on what is left.

Defined results: null text stays null; blank lines stay; rows without a
doc_id come last; rows that repeat doc_id and text count as one document, so
they lose the same lines; all columns and rows of the input return, under their
names, but for one named as the column of counts, which that replaces; lines and
texts of any length are compared whole; no documents, no rows.

A key hands back one line, so of two earlier lines whose 64-bit variant keys
collide only one is looked at; among 1e13 variants a key collides with a
probability of about 5e-7. That may leave a repeat, and never takes a line wrongly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, Scratch, bounded, free_prefix

EDIT_WORDS = 10
_LAST = 2**63 - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (null: last), t (hash of the text) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))


def _count(s: Column, c: str) -> Column:
    """How often a one-byte string stands in s."""
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(c), F.lit("")))


def _lines(docs: DataFrame, least_words: int) -> DataFrame:
    """doc, t, line (from 0), the line in lower case with single spaces between
    its words, and the number of words, of every line of least_words or more (at least one)."""
    raw = F.col("raw")
    odd = raw.startswith(" ") | raw.endswith(" ")
    for s in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd |= F.contains(raw, F.lit(s))
    rows = _keyed(docs).where("text is not null").select("doc", "t", F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "raw"))
    plain = F.when(odd, F.trim(F.regexp_replace(raw, f"[{BLANK}]+", " "))).otherwise(raw)
    rows = rows.select("doc", "t", "line", plain.alias("words")).where("words <> ''")
    return rows.withColumn("n", _count(F.col("words"), " ") + 1).where(F.col("n") >= least_words)


def _first(words: Column, n: Column) -> Column:
    return F.call_function("substring_index", words, F.lit(" "), n)


def _halves(words: Column, n: Column) -> list[Column]:
    """Up to four keys: the first and last h words, for h of this length and of one word less."""

    def key(side: int, h: Column) -> Column:
        return F.xxhash64(F.lit(side), h, _first(words, h if side == 0 else -h))

    h, g = F.floor((n - 1) / 2).cast("int"), F.floor((n - 2) / 2).cast("int")
    use, also = n >= EDIT_WORDS, (n >= EDIT_WORDS) & (g < h)
    return [F.when(use, key(0, h)).alias("k0"), F.when(use, key(1, h)).alias("k1"), F.when(also, key(0, g)).alias("k2"), F.when(also, key(1, g)).alias("k3")]


def _without(words: Column, n: Column, i: Column) -> Column:
    """The line less its i-th word; the line itself for -1."""
    rest = F.concat_ws(" ", F.nullif(_first(words, i), F.lit("")), F.nullif(_first(words, i - n + 1), F.lit("")))
    return F.when(i < 0, words).otherwise(rest)


def removed_lines(docs: DataFrame, scratch: Scratch, least_words: int = 1) -> DataFrame:
    """doc, t and the numbers of the lines that go, for documents that lose some."""
    words, n = F.col("words"), F.col("n")
    hashed = scratch.cut(_lines(docs, least_words).select("doc", "t", "line", "n", F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(1), words).alias("h2"), *_halves(words, n)))
    place = F.struct("doc", "t", "line")
    first = [F.first(c).alias(c) for c in ("n", "k0", "k1", "k2", "k3")]
    classes = scratch.cut(hashed.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("copies"), *first))

    halves = classes.where(n >= EDIT_WORDS).select("h1", "h2", F.explode(F.array_compact(F.array("k0", "k1", "k2", "k3"))).alias("k"))
    met = halves.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("k")
    near = halves.join(met, "k", "left_semi").select("h1", "h2").distinct()
    near = scratch.cut(classes.select("h1", "h2", "at").join(near, ["h1", "h2"], "left_semi"))
    wanted = near.select(F.col("at.doc").alias("doc_")).distinct()
    lines = _lines(docs.select("doc_id", "text").join(bounded(wanted), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) == F.col("doc_"), "left_semi"), EDIT_WORDS)
    own = near.select(F.col("at.doc").alias("doc"), F.col("at.t").alias("t"), F.col("at.line").alias("line"))
    texts = scratch.cut(lines.join(own, ["doc", "t", "line"]).dropDuplicates(["doc", "t", "line"]).select(place.alias("at"), "words", "n"))

    # The variants of every candidate; i is the word left out, -1 for the whole line.
    # A line's hash is the xor of its words' hashes with their places, so a variant's
    # follows from running xors: places before i as they are, those behind it one less.
    in_line = Window.partitionBy("at").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_line = Window.partitionBy("at").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spelled = texts.select("at", F.posexplode(F.split("words", " ")).alias("i", "w"))
    spelled = spelled.select("at", "i", F.xxhash64("w", "i").alias("here"), F.xxhash64("w", F.col("i") - 1).alias("moved"))
    xor = lambda c, over: F.bit_xor(c).over(over)
    summed = spelled.select("at", "i", "here", xor("here", in_line).alias("to"), xor("moved", in_line).alias("moved_to"), xor("moved", of_line).alias("moved_all"), xor("here", of_line).alias("all"))
    less = F.struct("i", F.col("to").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("moved_all")).bitwiseXOR(F.col("moved_to")).alias("k"))
    whole = F.struct(F.lit(-1).alias("i"), F.col("all").alias("k"))
    emitted = summed.select("at", F.explode(F.when(F.col("i") == 0, F.array(whole, less)).otherwise(F.array(less))).alias("v"))
    emitted = scratch.cut(emitted.select("at", "v.i", "v.k"))
    shared = emitted.groupBy("k").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo < hi").select("k")
    emitted = scratch.cut(emitted.join(shared, "k", "left_semi"))
    same = emitted.groupBy("k", "i").agg(F.min("at").alias("same"))
    other = emitted.groupBy("k").agg(F.min(F.when(F.col("i") < 0, F.struct("at", "i"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.struct("at", "i"))).alias("less"))
    # found: the earliest line of a key; mine and theirs: the words left out on either side (-1: none).
    hit = lambda at, mine, theirs: F.struct(at.alias("found"), mine.alias("mine"), theirs.alias("theirs"))
    replaced = F.when(F.col("i") >= 0, hit(F.col("same"), F.col("i"), F.col("i")))
    resized = F.when(F.col("i") >= 0, F.when(F.col("whole").isNotNull(), hit(F.col("whole.at"), F.col("i"), F.lit(-1)))).otherwise(F.when(F.col("less").isNotNull(), hit(F.col("less.at"), F.lit(-1), F.col("less.i"))))
    hits = emitted.join(same, ["k", "i"]).join(other, "k").select("at", F.explode(F.array_compact(F.array(replaced, resized))).alias("x"))
    best = hits.groupBy("at").agg(F.min("x").alias("x")).where("x.found < at").select("at", "x.found", "x.mine", "x.theirs")
    # Verified: the lines are equal but for the words left out, one on either side at most.
    left = texts.select("at", F.col("words").alias("a"), F.col("n").alias("n_a"))
    right = texts.select(F.col("at").alias("found"), F.col("words").alias("b"), F.col("n").alias("n_b"))
    alike = _without(F.col("a"), F.col("n_a"), F.col("mine")) == _without(F.col("b"), F.col("n_b"), F.col("theirs"))
    gone = best.join(left, "at").join(right, "found").where(alike).select("at")

    verdicts = classes.join(gone.withColumn("gone", F.lit(True)), "at", "left").where("copies > 1 or gone").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "at", F.coalesce("gone", F.lit(False)).alias("gone"))
    places = hashed.select("doc", "t", "line", "h1", "h2")
    out = places.join(verdicts, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(F.col("gone") | (place != F.col("at")))
    return out.groupBy("doc", "t").agg(F.collect_set("line").alias("lines"))


def dedup(docs: DataFrame, removed: DataFrame, counted: str | None = "_line_dedup") -> DataFrame:
    """docs with the lines gone from text, and a column of counts (n_lines, n_removed), in place of any of that name; None: no such column."""
    p = free_prefix(docs)
    gone = removed.select(*[F.col(c).alias(p + c) for c in ("doc", "t", "lines")])
    text, lines = F.col("text").cast("string"), F.col(f"{p}lines")
    on = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) == F.col(f"{p}doc")) & (F.xxhash64(text) == F.col(f"{p}t"))
    kept = F.when(lines.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda s, i: ~F.array_contains(lines, i)), "\n"))
    counts = F.struct((_count(text, "\n") + 1).alias("n_lines"), F.coalesce(F.size(lines), F.lit(0)).alias("n_removed"))
    counts = F.when(text.isNull(), F.struct(F.lit(0).alias("n_lines"), F.lit(0).alias("n_removed"))).otherwise(counts)
    own = [kept.alias("text") if c == "text" else F.col(c) for c in docs.columns if c != counted]
    return docs.join(gone, on, "left").select(*own, *([counts.alias(counted)] if counted else []))


def dedup_lines(docs: DataFrame, counted: str | None = "_line_dedup", least_words: int = 1) -> DataFrame:
    """docs without the lines that an earlier line repeats; the column ``counted`` counts them. Lines of fewer than least_words stay."""
    scratch = Scratch(docs.sparkSession)
    return dedup(docs, scratch.cut(removed_lines(docs, scratch, least_words)), counted)


#: The same in DuckDB SQL, on words instead of hashes.
SQL = rf"""
WITH l AS (SELECT doc_id, line - 1 AS line, lower(raw) AS raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, line, regexp_extract_all(raw, '[^{BLANK}]+') AS words FROM l),
c AS (SELECT words, min((doc_id, line)) AS place FROM w WHERE words <> [] GROUP BY words),
e AS (SELECT * FROM c WHERE len(words) >= {EDIT_WORDS}),
v AS (SELECT place, i, list_concat(words[:i-1], words[i+1:]) AS rest FROM (SELECT place, words, unnest(range(1, len(words) + 1)) AS i FROM e)),
near AS (
  SELECT a.place FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i AND b.place < a.place
  UNION SELECT a.place FROM v a JOIN e b ON a.rest = b.words AND b.place < a.place
  UNION SELECT a.place FROM e a JOIN v b ON a.words = b.rest AND b.place < a.place),
gone AS (SELECT w.doc_id, w.line FROM w JOIN c ON w.words = c.words WHERE (w.doc_id, w.line) <> c.place OR c.place IN (SELECT place FROM near)),
k AS (SELECT doc_id, list(line) AS lines FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(lines), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda s, i: NOT list_contains(coalesce(lines, []), i - 1)), chr(10)), '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
