"""CSV files and the driver's tables as bank rows and ledger lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MatchConfig
from ..functions.parse import parse_amount_prefix, parse_amount_whole, parse_ts
from ..functions.text import tokenize
from ..operators.numbering import count_up


#: A field, behind its comma: text without quotes or commas, and parts in quotes (to the line's end, if none closes them).
_FIELD = r',((?:[^",]++|"(?:[^"]++|"")*+(?:"|$))*+)'
_QUOTED = r'"((?:[^"]++|"")*+)(?:"|$)'


def split_record(line: Column) -> Column:
    """The fields of a line: a quote opens or closes quoted text anywhere in a field, and within it two are one."""
    plain = lambda f: F.when(F.contains(f, F.lit('"')), F.replace(F.regexp_replace(f, _QUOTED, "$1"), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1)), plain)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, under their exact header names, with ``_row`` (from 0, in file order).

    Short rows are padded with nulls and empty fields are null; blank lines do
    not count; of columns with one name the last counts. A field may have quoted
    parts anywhere, which may hold commas and doubled quotes. Lines are read
    and split where they lie, by as many tasks as the file has blocks. Only a
    file with a line end in quotes (a line with an odd number of quotes) is
    read whole, by one task, and there a quoted field must begin with its quote.
    An empty file is an error, a header alone is an empty table. Of a folder
    with several files, each begins with the header.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"))
    head = lines.limit(1).collect()
    if not head:
        raise ValueError(f"Empty input: {path}")
    line = head[0][0]
    names = spark.range(1).select(split_record(F.lit(line.lstrip("\ufeff")))).first()[0]
    last = {name: i for i, name in enumerate(names)}
    odd = F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))
    if lines.where(odd % 2 == 1).take(1):
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True)
        rows = rows.select(*[F.col(f"_c{i}").alias(name) for name, i in last.items()], F.monotonically_increasing_id().alias("_at"))
    else:
        # The header is the first line of all, or in a folder of files the line that equals it in a file's first block.
        raw = spark.read.text(path)
        first = (F.col("_metadata.file_block_start") == 0) & (F.col("line") == line) if len(raw.inputFiles()) > 1 else F.col("_id") == 0
        rows = raw.select(F.regexp_replace("value", r"\r$", "").alias("line"), "_metadata", F.monotonically_increasing_id().alias("_id"))
        rows = rows.where((F.col("line") != "") & ~first).select(split_record(F.col("line")).alias("_f"), F.monotonically_increasing_id().alias("_at"))
        rows = rows.select(*[F.nullif(F.get("_f", F.lit(i)), F.lit("")).alias(name) for name, i in last.items()], "_at")
    return count_up(rows, "_at", "_row")


def column(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """A column by its exact name, or the default where the table lacks it."""
    return F.col(f"`{name}`").cast("string") if name in df.columns else (F.lit("") if default is None else default)


def amount(s: Column, config: MatchConfig) -> Column:
    return parse_amount_prefix(s) if config.prefix_numbers else parse_amount_whole(s)


def bank_rows(raw: DataFrame, config: MatchConfig, index: str = "_row") -> DataFrame:
    """Typed bank rows of a table of texts."""
    when, text = column(raw, "datetime"), column(raw, "description")
    keep = (lambda c: c) if config.need_description else (lambda c: F.coalesce(c, F.lit("")))
    rows = raw.select(F.col(index).cast("long").alias("bank_idx"), when.alias("bank_datetime"), amount(column(raw, "amount"), config).alias("bank_amount"), keep(text).alias("bank_description"))
    return finish_bank(rows.withColumn("bank_ts", parse_ts(F.col("bank_datetime"), extra=not config.prefix_numbers)), config)


def finish_bank(rows: DataFrame, config: MatchConfig) -> DataFrame:
    if config.nan_text:
        rows = rows.withColumn("bank_description", F.coalesce("bank_description", F.lit("nan")))
    return rows.select("bank_idx", "bank_datetime", "bank_ts", F.to_date("bank_ts").alias("bank_day"), "bank_amount", "bank_description", tokenize(F.col("bank_description")).alias("bank_tokens"))


def ledger_lines(raw: DataFrame, config: MatchConfig, index: str = "_row") -> DataFrame:
    """line_no, journal_entry_id, datetime, ts, amount, description of a table of texts."""
    key = column(raw, "journal_entry_id", F.col(index).cast("string"))
    if config.null_keys:
        key = F.coalesce(key, F.lit(""))
    when = column(raw, "datetime")
    rows = raw.select(F.col(index).cast("long").alias("line_no"), key.alias("journal_entry_id"), when.alias("datetime"), amount(column(raw, "amount"), config).alias("amount"), column(raw, "description").alias("description"))
    return rows.withColumn("ts", parse_ts(F.col("datetime"), extra=not config.prefix_numbers))


# The driver's tables.


def events_bank(spark: SparkSession, sf_dir: str, config: MatchConfig) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
    rows = rows.select(F.col("event_id").cast("long").alias("bank_idx"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("bank_datetime"), F.col("ts").alias("bank_ts"), F.col("value").alias("bank_amount"), F.col("props").alias("bank_description"))
    return finish_bank(rows, config)


def events_entries(spark: SparkSession, sf_dir: str, config: MatchConfig) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'")
    return rows.select(
        F.col("event_id").cast("long").alias("gl_idx"), F.col("event_id").cast("string").alias("journal_entry_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("gl_datetime"),
        F.col("ts").alias("gl_ts"), F.to_date("ts").alias("gl_day"), F.col("value").alias("gl_amount"), F.col("props").alias("gl_description"), tokenize(F.col("props")).alias("gl_tokens"),
    )


#: Lines repeat (order, number), so all of these order an order's lines.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger lines: an order is a journal entry; line_no orders the lines of an entry and follows the orders' keys."""
    line, part = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = line.join(part.select("p_partkey", "p_name"), line.l_partkey == part.p_partkey)
    return rows.select(
        F.struct("l_orderkey", *LINE_ORDER).alias("line_no"), F.col("l_orderkey").cast("string").alias("journal_entry_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("datetime"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_extendedprice").alias("amount"), F.col("p_name").alias("description"),
    )


def lineitem_bank(entries: DataFrame, firsts: DataFrame, config: MatchConfig) -> DataFrame:
    """A bank row per order: its sum with the sign turned and a jitter of cents and days, its first line's text."""
    key = F.col("journal_entry_id").cast("long")
    rows = entries.select("journal_entry_id", "gl_ts", "gl_amount").join(firsts.select("journal_entry_id", "gl_description"), "journal_entry_id")
    days = F.make_dt_interval((key % 37 - 18).cast("int"))
    rows = rows.select(key.alias("bank_idx"), (F.to_date("gl_ts").cast("timestamp_ntz") + days).alias("bank_ts"), (-F.col("gl_amount") + (key % 7 - 3).cast("double") * F.lit(0.04)).alias("bank_amount"), F.col("gl_description").alias("bank_description"))
    return finish_bank(rows.withColumn("bank_datetime", F.date_format("bank_ts", "yyyy-MM-dd")), config)
