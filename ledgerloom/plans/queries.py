"""Registered reconciliation queries and the same in DuckDB SQL.

Adapters: EV matches the purchases of ``events`` with its errors (dense, full
of ties); LI takes the orders of ``lineitem`` as journal entries of several
lines, with a bank row made for each by modular jitter.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GREEDY, MAXFLOW
from ..functions.parse import parse_amount_prefix, parse_amount_whole, parse_ts
from ..functions.text import concat_nonempty, indel_ratio, jaccard, tokenize
from ..operators import candidates as C
from ..operators import matching as M
from ..operators import report as R
from ..operators import rows as W
from ..operators.numbering import numbered
from ..operators.ledger import aggregate_entries, entry_dates
from ..sources import tables as S
from ..sources.sinks import json_lines


def _ev(spark: SparkSession, sf_dir: str, config=GREEDY) -> tuple[DataFrame, DataFrame]:
    return S.events_bank(spark, sf_dir, config), S.events_entries(spark, sf_dir, config)


def _li(spark: SparkSession, sf_dir: str, number: bool = True) -> tuple[DataFrame, DataFrame]:
    lines = S.lineitem_lines(spark, sf_dir)
    entries = aggregate_entries(lines, GREEDY, number=False).withColumn("gl_idx", F.col("journal_entry_id").cast("long"))
    firsts = aggregate_entries(lines, MAXFLOW, number=False)
    return S.lineitem_bank(entries, firsts, GREEDY), entries


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and amounts written in many ways, from the events' keys."""
    k, ts = F.col("event_id"), F.col("ts")
    md = F.concat(F.month(ts).cast("string"), F.lit("/"), F.dayofmonth(ts).cast("string"), F.lit("/"))
    yy = F.lpad(((k * 7) % 100).cast("string"), 2, "0")
    hm = F.concat(F.hour(ts).cast("string"), F.lit(":"), F.lpad(F.minute(ts).cast("string"), 2, "0"))
    second = F.lpad(F.second(ts).cast("string"), 2, "0")
    year = F.year(ts).cast("string")
    forms = [F.concat(md, yy, F.lit(" "), hm), F.concat(md, yy, F.lit(" "), hm, F.lit(":"), second), F.concat(F.lit("  "), md, yy, F.lit(" ")), F.concat(md, year, F.lit(" "), hm), F.concat(md, year, F.lit(" "), hm, F.lit(":"), second), F.concat(md, year), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd"), F.lit("bad"), F.lit("2/30/24"), F.lit("")]
    when = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        when = F.when(k % len(forms) == i, form).otherwise(when)
    n = F.concat(F.when(k % 2 == 1, F.lit("-")).otherwise(F.lit("")), k.cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    tails = [n, F.concat(n, F.lit("abc")), F.concat(F.lit("  "), n, F.lit(" ")), F.concat(F.lit("1,"), k.cast("string")), F.concat(F.lit("$"), n), F.lit(""), F.concat(F.lit(".5e1x"), k.cast("string")), F.lit("inf")]
    amount = F.lit(None).cast("string")
    for i, tail in enumerate(tails):
        amount = F.when(k % len(tails) == i, tail).otherwise(amount)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(k.alias("event_id"), when.alias("when_text"), amount.alias("amount_text"))


_TEXTS = """SELECT event_id,
  CASE event_id % 11 WHEN 0 THEN md || yy || ' ' || hm WHEN 1 THEN md || yy || ' ' || hm || ':' || sec WHEN 2 THEN '  ' || md || yy || ' ' WHEN 3 THEN md || y || ' ' || hm
    WHEN 4 THEN md || y || ' ' || hm || ':' || sec WHEN 5 THEN md || y WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 7 THEN strftime(ts, '%Y-%m-%d') WHEN 8 THEN 'bad' WHEN 9 THEN '2/30/24' ELSE '' END AS when_text,
  CASE event_id % 8 WHEN 0 THEN n WHEN 1 THEN n || 'abc' WHEN 2 THEN '  ' || n || ' ' WHEN 3 THEN '1,' || event_id WHEN 4 THEN '$' || n WHEN 5 THEN '' WHEN 6 THEN '.5e1x' || event_id ELSE 'inf' END AS amount_text
FROM (SELECT event_id, ts, month(ts) || '/' || day(ts) || '/' AS md, lpad(((event_id * 7) % 100)::VARCHAR, 2, '0') AS yy, hour(ts) || ':' || lpad(minute(ts)::VARCHAR, 2, '0') AS hm,
  lpad(second(ts)::VARCHAR, 2, '0') AS sec, year(ts)::VARCHAR AS y, CASE WHEN event_id % 2 = 1 THEN '-' ELSE '' END || event_id || '.' || lpad((event_id % 100)::VARCHAR, 2, '0') AS n FROM events)"""

_FORMATS = ("%m/%d/%y %H:%M", "%m/%d/%y %H:%M:%S", "%m/%d/%y", "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d")


def parse_dates(spark, sf_dir):
    rows = _texts(spark, sf_dir)
    ts = parse_ts(F.col("when_text"))
    return rows.select("event_id", "when_text", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("parsed"), F.date_format(ts, "yyyy-MM-dd").alias("day"))


def parse_amounts(spark, sf_dir):
    t = F.col("amount_text")
    value, finite = parse_amount_prefix(t), lambda c: F.when(F.abs(c) < float("inf"), F.round(c, 2))
    return _texts(spark, sf_dir).select("event_id", "amount_text", finite(value).alias("prefix"), F.coalesce(value == float("inf"), F.lit(False)).alias("infinite"), finite(parse_amount_whole(t)).alias("whole"), finite(F.coalesce(value, F.lit(0.0))).alias("ledger"))


def row_index(spark, sf_dir):
    bank, _ = _ev(spark, sf_dir)
    return numbered(bank.select("bank_idx"), ["bank_idx"], "row_index")


def _holed(spark, sf_dir):
    bank, _ = _ev(spark, sf_dir)
    k = F.col("bank_idx")
    hole = lambda c, m: F.when(k % m != 0, F.col(c)).alias(c)
    return bank.select("bank_idx", hole("bank_ts", 5), hole("bank_day", 5), hole("bank_amount", 7), hole("bank_description", 11), "bank_tokens")


def valid_rows(spark, sf_dir):
    rows = _holed(spark, sf_dir)
    strict = C.valid_bank(rows, MAXFLOW).select("bank_idx", F.lit(True).alias("strict"))
    return C.valid_bank(rows, GREEDY).join(strict, "bank_idx", "left").select("bank_idx", F.round("bank_amount", 2).alias("bank_amount"), F.coalesce("strict", F.lit(False)).alias("with_description"))


def valid_entries(spark, sf_dir):
    _, entries = _ev(spark, sf_dir)
    k = F.col("gl_idx")
    hole = lambda c, m: F.when(k % m != 0, F.col(c)).alias(c)
    rows = entries.select("gl_idx", hole("gl_ts", 5), hole("gl_day", 5), F.when(k % 13 == 0, F.lit(float("inf"))).when(k % 7 != 0, F.col("gl_amount")).alias("gl_amount"), hole("gl_description", 11))
    strict = C.valid_entries(rows, MAXFLOW).select("gl_idx", F.lit(True).alias("strict"))
    return C.valid_entries(rows, GREEDY).join(strict, "gl_idx", "left").select("gl_idx", F.round("gl_amount", 2).alias("gl_amount"), F.coalesce("strict", F.lit(False)).alias("with_description"))


def csv_fields(spark, sf_dir):
    """Records with quotes at the start, in the middle and doubled."""
    k = F.col("event_id").cast("string")
    line = F.concat(k, F.lit(',x"'), "event_type", F.lit(', y"z,"a ""'), k, F.lit('"" b",,""'))
    fields = S.split_record(line)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *[F.get(fields, F.lit(i)).alias(f"f{i}") for i in range(5)], F.size(fields).cast("long").alias("n"))


def missing_columns(spark, sf_dir):
    """Ledger lines and bank rows of a table that has amounts only."""
    raw = _texts(spark, sf_dir).select(F.col("event_id").alias("_row"), F.col("amount_text").alias("amount"))
    lines, bank = S.ledger_lines(raw, GREEDY), S.bank_rows(raw, GREEDY)
    return lines.join(bank, lines.line_no == bank.bank_idx).select("line_no", "journal_entry_id", "datetime", "description", "bank_datetime", "bank_description", F.col("ts").isNull().alias("undated"))


def ledger_totals(spark, sf_dir):
    """Amounts below a cent and beyond 1e15, added one after the other and in cents."""
    n = F.col("line_no.l_linenumber")
    lines = S.lineitem_lines(spark, sf_dir).withColumn("amount", F.when(n == 1, F.lit(2e15)).when(n == 2, F.lit(None).cast("double")).otherwise(F.col("amount") * F.lit(0.001)))
    ordered = aggregate_entries(lines, GREEDY, number=False).select("journal_entry_id", F.col("gl_amount").alias("ordered_total"))
    cents = aggregate_entries(lines.where(n > 2), replace(MAXFLOW, total="decimal"), number=False).select("journal_entry_id", F.round("gl_amount", 2).alias("cents_total"))
    return ordered.join(cents, "journal_entry_id", "left")


def ledger_agg_concat(spark, sf_dir):
    out = aggregate_entries(S.lineitem_lines(spark, sf_dir), GREEDY)
    return out.select("gl_idx", "journal_entry_id", "gl_datetime", F.round("gl_amount", 2).alias("gl_amount"), "gl_description")


def ledger_agg_first(spark, sf_dir):
    lines = S.lineitem_lines(spark, sf_dir).withColumn("description", F.when(F.col("line_no.l_linenumber") != 1, F.col("description")))
    out = aggregate_entries(lines, MAXFLOW)
    return out.select("gl_idx", "journal_entry_id", F.date_format("gl_ts", "yyyy-MM-dd").alias("gl_day"), F.round("gl_amount", 2).alias("gl_amount"), "gl_description")


def entry_date_lookup(spark, sf_dir):
    dates = entry_dates(S.lineitem_lines(spark, sf_dir))
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("journal_entry_id"))
    return keys.join(dates, "journal_entry_id", "left").select("journal_entry_id", F.date_format("entry_ts", "yyyy-MM-dd").alias("entry_day"))


def tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.array_join(F.array_sort(tokenize(F.col("text"))), " ").alias("tokens"))


def concat_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", concat_nonempty(F.array("lang", F.lit(""), "source", F.lit(None).cast("string"))).alias("joined"))


def _pairs(spark, sf_dir, config=GREEDY):
    return C.candidates(*_ev(spark, sf_dir, config), config)


def candidates_band(spark, sf_dir):
    return _pairs(spark, sf_dir).select("bank_idx", "gl_idx")


def candidates_band_lines(spark, sf_dir):
    return C.candidates(*_li(spark, sf_dir), GREEDY).select("bank_idx", "gl_idx")


def candidates_days(spark, sf_dir):
    return C.candidates(*_ev(spark, sf_dir), GREEDY, day_buckets=True).select("bank_idx", "gl_idx")


def candidates_strict(spark, sf_dir):
    return _pairs(spark, sf_dir, MAXFLOW).select("bank_idx", "gl_idx", F.col("score").cast("long").alias("distance"))


def jaccard_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("bank_idx", "gl_idx", F.round("score", 6).alias("score"))


def _names(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.alias("a").join(part.alias("b"), F.col("a.p_partkey") + 1 == F.col("b.p_partkey")).select(F.col("a.p_partkey").alias("p_partkey"), F.col("a.p_name").alias("x"), F.col("b.p_name").alias("y"))


def levenshtein_pairs(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", F.levenshtein("x", "y").cast("long").alias("distance"))


def indel_ratio_pairs(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", F.round(indel_ratio("x", "y"), 6).alias("ratio"))


def jaccard_names(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", F.round(jaccard(tokenize(F.col("x")), tokenize(F.col("y"))), 6).alias("score"))


def edge_order(spark, sf_dir):
    return W.ranked_edges(*_ev(spark, sf_dir), GREEDY)


def match_greedy(spark, sf_dir):
    found = W.match_rows(*_ev(spark, sf_dir), GREEDY)
    return found.select("bank_idx", "gl_idx", F.round("score", 6).alias("score"))


def pick_order(spark, sf_dir):
    """The matches with their place in the output's order."""
    found = W.match_rows(*_ev(spark, sf_dir), GREEDY)
    return numbered(found, [F.col("score").desc(), "bank_idx", "gl_idx"], "place").select("place", "bank_idx", "gl_idx")


def match_greedy_lines(spark, sf_dir):
    found = M.match(C.candidates(*_li(spark, sf_dir), GREEDY), GREEDY)
    return found.select("bank_idx", "gl_idx", F.round("score", 6).alias("score"))


def match_greedy_rounds(spark, sf_dir):
    # Two rounds: pairs of equal texts, each text apart; then what is left, by islands.
    found = W.match_rows(*_ev(spark, sf_dir), GREEDY)
    return found.select("bank_idx", "gl_idx", F.round("score", 6).alias("score"))


def match_max_cardinality(spark, sf_dir):
    found = W.maximum_rows(*_ev(spark, sf_dir, MAXFLOW), MAXFLOW)
    return found.select("bank_idx", "gl_idx", F.col("score").cast("long").alias("distance"))


def flow_value(spark, sf_dir):
    return W.maximum_size(*_ev(spark, sf_dir, MAXFLOW), MAXFLOW).select(F.col("n").alias("flow"))


def export_records(spark, sf_dir):
    bank, entries = _ev(spark, sf_dir)
    return R.records(W.match_rows(bank, entries, GREEDY), bank, entries, GREEDY)


def export_json(spark, sf_dir):
    return json_lines(export_records(spark, sf_dir).select("journal_entry_id", "gl_datetime", "bank_index", "bank_datetime", "bank_description"))


def export_max_cardinality(spark, sf_dir):
    bank, entries = _ev(spark, sf_dir, MAXFLOW)
    out = R.records(W.maximum_rows(bank, entries, MAXFLOW), bank, entries, MAXFLOW)
    return out.withColumn("score", F.round("score", 6))


def summary(spark, sf_dir):
    bank, entries = _ev(spark, sf_dir)
    return R.summary(W.match_rows(bank, entries, GREEDY), bank, entries)


def unmatched_bank(spark, sf_dir):
    bank, entries = _ev(spark, sf_dir)
    return R.unmatched(bank, W.match_rows(bank, entries, GREEDY), "bank_idx").select("bank_idx")


def unmatched_entry(spark, sf_dir):
    bank, entries = _ev(spark, sf_dir)
    return R.unmatched(entries, W.match_rows(bank, entries, GREEDY), "gl_idx").select("gl_idx")


_EV = """bank AS (SELECT event_id AS bank_idx, ts, ts::DATE AS day, value AS amount, props AS txt FROM events WHERE event_type = 'purchase'),
entry AS (SELECT event_id AS gl_idx, ts, ts::DATE AS day, value AS amount, props AS txt FROM events WHERE event_type = 'error')"""
_TOKENS = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda x: lower(x)))"
_JACCARD = "CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END"
_CAND = f"""{_EV},
cand AS (SELECT bank_idx AS b, gl_idx AS g, round({_JACCARD}, 6) AS s FROM (
  SELECT bank_idx, gl_idx, {_TOKENS.format("k.txt")} AS a, {_TOKENS.format("e.txt")} AS b
  FROM bank k JOIN entry e ON abs(date_diff('day', k.day, e.day)) <= 15 AND abs(abs(k.amount) - abs(e.amount)) <= 0.1::DOUBLE))"""
_GREEDY = """live AS (SELECT 1 AS rnd, b, g, s FROM cand
  UNION ALL SELECT rnd + 1, b, g, s FROM (SELECT *, max(dom) OVER (PARTITION BY b) AS db, max(dom) OVER (PARTITION BY g) AS dg FROM (
    SELECT *, (row_number() OVER (PARTITION BY b ORDER BY s DESC, g) = 1 AND row_number() OVER (PARTITION BY g ORDER BY s DESC, b) = 1)::INT AS dom FROM live)) WHERE db = 0 AND dg = 0),
matched AS (SELECT b, g, s FROM (SELECT *, row_number() OVER (PARTITION BY rnd, b ORDER BY s DESC, g) AS rb, row_number() OVER (PARTITION BY rnd, g ORDER BY s DESC, b) AS rg FROM live) WHERE rb = 1 AND rg = 1)"""
_LINES = "lines AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS n FROM lineitem JOIN part ON l_partkey = p_partkey)"
_LI = f"""{_LINES},
grouped AS (SELECT l_orderkey AS k, arg_min(l_shipdate, n)::DATE AS day, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount, arg_min(p_name, n) AS first_name, string_agg(p_name, ' ' ORDER BY n) AS names FROM lines GROUP BY l_orderkey),
entry AS (SELECT k AS gl_idx, day, amount, names AS txt FROM grouped),
bank AS (SELECT k AS bank_idx, day + (k % 37 - 18)::INT AS day, -amount + (k % 7 - 3)::DOUBLE * 0.04::DOUBLE AS amount, first_name AS txt FROM grouped),
cand AS (SELECT bank_idx AS b, gl_idx AS g, round({_JACCARD}, 6) AS s FROM (
  SELECT bank_idx, gl_idx, {_TOKENS.format("x.txt")} AS a, {_TOKENS.format("e.txt")} AS b
  FROM bank x JOIN entry e ON abs(date_diff('day', x.day, e.day)) <= 15 AND abs(abs(x.amount) - abs(e.amount)) <= 0.1::DOUBLE))"""
_NAMES = "SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey"
_STAMP = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"
_RECORD = f"""SELECT e.gl_idx::VARCHAR AS journal_entry_id, {_STAMP.format("e.ts")} AS gl_datetime, round(e.amount, 2) AS gl_amount, nullif(e.txt, '') AS gl_description,
  k.bank_idx AS bank_index, {_STAMP.format("k.ts")} AS bank_datetime, round(k.amount, 2) AS bank_amount, nullif(k.txt, '') AS bank_description, s AS score
FROM matched JOIN bank k ON b = k.bank_idx JOIN entry e ON g = e.gl_idx"""
_ORACLE = {
    "parse_dates": f"""SELECT event_id, when_text, strftime(t, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(t, '%Y-%m-%d') AS day FROM (SELECT *, coalesce({", ".join(f"try_strptime(trim(when_text), '{f}')" for f in _FORMATS)}) AS t FROM ({_TEXTS}))""",
    "parse_amounts": rf"""SELECT event_id, amount_text, round(p, 2) AS prefix, inf AS infinite, round(w, 2) AS whole, CASE WHEN inf THEN NULL ELSE round(coalesce(p, 0), 2) END AS ledger
FROM (SELECT *, amount_text = 'inf' AS inf, try_cast(nullif(regexp_extract(amount_text, '^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE) AS p, CASE WHEN amount_text = 'inf' THEN NULL ELSE try_cast(trim(amount_text) AS DOUBLE) END AS w FROM ({_TEXTS}))""",
    "row_index": "SELECT event_id AS bank_idx, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events WHERE event_type = 'purchase'",
    "valid_rows": "SELECT event_id AS bank_idx, round(value, 2) AS bank_amount, event_id % 11 <> 0 AS with_description FROM events WHERE event_type = 'purchase' AND event_id % 5 <> 0 AND event_id % 7 <> 0",
    "valid_entries": "SELECT event_id AS gl_idx, round(value, 2) AS gl_amount, event_id % 11 <> 0 AS with_description FROM events WHERE event_type = 'error' AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 13 <> 0",
    "csv_fields": "SELECT event_id, event_id::VARCHAR AS f0, 'x' || event_type || ', yz' AS f1, 'a \"' || event_id || '\" b' AS f2, '' AS f3, '' AS f4, 5::BIGINT AS n FROM events",
    "missing_columns": "SELECT event_id AS line_no, event_id::VARCHAR AS journal_entry_id, '' AS datetime, '' AS description, '' AS bank_datetime, '' AS bank_description, true AS undated FROM events",
    "ledger_totals": f"""WITH {_LINES}, v AS (SELECT l_orderkey, n, l_linenumber, CASE l_linenumber WHEN 1 THEN 2e15::DOUBLE WHEN 2 THEN 0::DOUBLE ELSE l_extendedprice * 0.001::DOUBLE END AS v FROM lines)
SELECT l_orderkey::VARCHAR AS journal_entry_id, list_reduce(list(v ORDER BY n), lambda a, b: a + b) AS ordered_total, round((sum(round(v, 2)::DECIMAL(18,2)) FILTER (l_linenumber > 2))::DOUBLE, 2) AS cents_total FROM v GROUP BY l_orderkey""",
    "ledger_agg_concat": f"WITH {_LINES} SELECT row_number() OVER (ORDER BY min(n)) - 1 AS gl_idx, l_orderkey::VARCHAR AS journal_entry_id, strftime(arg_min(l_shipdate, n), '%Y-%m-%d') AS gl_datetime, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS gl_amount, string_agg(p_name, ' ' ORDER BY n) AS gl_description FROM lines GROUP BY l_orderkey",
    "ledger_agg_first": f"WITH {_LINES} SELECT row_number() OVER (ORDER BY l_orderkey::VARCHAR) - 1 AS gl_idx, l_orderkey::VARCHAR AS journal_entry_id, strftime(arg_min(l_shipdate, n), '%Y-%m-%d') AS gl_day, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS gl_amount, arg_min(p_name, n) FILTER (l_linenumber <> 1) AS gl_description FROM lines GROUP BY l_orderkey",
    "entry_date_lookup": f"WITH {_LINES}, d AS (SELECT l_orderkey, arg_min(l_shipdate, n) AS t FROM lines GROUP BY l_orderkey) SELECT o_orderkey::VARCHAR AS journal_entry_id, strftime(t, '%Y-%m-%d') AS entry_day FROM orders LEFT JOIN d ON o_orderkey = l_orderkey",
    "tokens": f"SELECT doc_id, array_to_string(list_sort({_TOKENS.format('text')}), ' ') AS tokens FROM documents",
    "concat_text": "SELECT doc_id, lang || ' ' || source AS joined FROM documents",
    "candidates_band": f"WITH {_CAND} SELECT b AS bank_idx, g AS gl_idx FROM cand",
    "candidates_band_lines": f"WITH {_LI} SELECT b AS bank_idx, g AS gl_idx FROM cand",
    "candidates_days": f"WITH {_CAND} SELECT b AS bank_idx, g AS gl_idx FROM cand",
    "candidates_strict": f"WITH {_EV} SELECT bank_idx, gl_idx, levenshtein(k.txt, e.txt)::BIGINT AS distance FROM bank k JOIN entry e ON floor((epoch_us(k.ts) - epoch_us(e.ts)) / 86400000000.0) BETWEEN -15 AND 15 AND abs(abs(k.amount) - abs(e.amount)) <= 0.01::DOUBLE",
    "jaccard_pairs": f"WITH {_CAND} SELECT b AS bank_idx, g AS gl_idx, s AS score FROM cand",
    "levenshtein_pairs": f"SELECT p_partkey, levenshtein(x, y)::BIGINT AS distance FROM ({_NAMES})",
    # Rows of the common-subsequence table, a step for each letter of y; within a row the running maximum.
    "indel_ratio_pairs": f"""WITH RECURSIVE p AS ({_NAMES}), d AS (SELECT DISTINCT x, y FROM p), r AS (
  SELECT x, y, 0 AS j, list_transform(range(0, len(x) + 1), lambda i: 0::BIGINT) AS row FROM d
  UNION ALL SELECT x, y, j + 1, list_transform(range(1, len(x) + 2), lambda i: list_max(list_transform(range(1, i + 1), lambda k: greatest(row[k], CASE WHEN k > 1 AND x[k - 1] = y[j + 1] THEN row[k - 1] + 1 ELSE 0 END)))) FROM r WHERE j < len(y))
SELECT p_partkey, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0::DOUBLE * row[len(x) + 1] / (len(x) + len(y)) END, 6) AS ratio FROM p JOIN r USING (x, y) WHERE j = len(y)""",
    "jaccard_names": f"SELECT p_partkey, round({_JACCARD}, 6) AS score FROM (SELECT p_partkey, {_TOKENS.format('x')} AS a, {_TOKENS.format('y')} AS b FROM ({_NAMES}))",
    "edge_order": f"WITH {_CAND} SELECT b AS bank_idx, g AS gl_idx, row_number() OVER (ORDER BY s DESC, b, g) AS edge_rank FROM cand",
    "match_greedy": f"WITH RECURSIVE {_CAND}, {_GREEDY} SELECT b AS bank_idx, g AS gl_idx, s AS score FROM matched",
    "pick_order": f"WITH RECURSIVE {_CAND}, {_GREEDY} SELECT row_number() OVER (ORDER BY s DESC, b, g) - 1 AS place, b AS bank_idx, g AS gl_idx FROM matched",
    "match_greedy_lines": f"WITH RECURSIVE {_LI}, {_GREEDY} SELECT b AS bank_idx, g AS gl_idx, s AS score FROM matched",
    "match_greedy_rounds": f"WITH RECURSIVE {_CAND}, {_GREEDY} SELECT b AS bank_idx, g AS gl_idx, s AS score FROM matched",
    "export_records": f"WITH RECURSIVE {_CAND}, {_GREEDY} {_RECORD}",
    "export_json": f"""WITH RECURSIVE {_CAND}, {_GREEDY} SELECT json_object('journal_entry_id', journal_entry_id, 'gl_datetime', gl_datetime, 'bank_index', bank_index, 'bank_datetime', bank_datetime, 'bank_description', bank_description)::VARCHAR AS value FROM ({_RECORD})""",
    "summary": f"""WITH RECURSIVE {_CAND}, {_GREEDY}, n AS (SELECT (SELECT count(*) FROM entry) AS gl_entries, (SELECT count(*) FROM bank) AS bank_transactions, (SELECT count(*) FROM matched) AS matched)
SELECT *, round(100.0::DOUBLE * matched / bank_transactions, 1) AS bank_match_rate, round(100.0::DOUBLE * matched / gl_entries, 1) AS gl_match_rate FROM n""",
    "unmatched_bank": f"WITH RECURSIVE {_CAND}, {_GREEDY} SELECT bank_idx FROM bank WHERE bank_idx NOT IN (SELECT b FROM matched)",
    "unmatched_entry": f"WITH RECURSIVE {_CAND}, {_GREEDY} SELECT gl_idx FROM entry WHERE gl_idx NOT IN (SELECT g FROM matched)",
}
_QUERIES = (
    parse_dates, parse_amounts, row_index, valid_rows, valid_entries, csv_fields, missing_columns, ledger_totals, pick_order, ledger_agg_concat, ledger_agg_first, entry_date_lookup, tokens, concat_text, candidates_band, candidates_band_lines, candidates_days, candidates_strict,
    jaccard_pairs, levenshtein_pairs, indel_ratio_pairs, jaccard_names, edge_order, match_greedy, match_greedy_lines, match_greedy_rounds, match_max_cardinality, flow_value, export_records, export_json,
    export_max_cardinality, summary, unmatched_bank, unmatched_entry,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    return dict(_ORACLE)
