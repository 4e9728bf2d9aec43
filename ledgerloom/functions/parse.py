"""Column expressions that read dates and numbers from text; bad values become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted formats in the order in which they are tried.
SHORT_YEAR = ("M/d/yy H:mm", "M/d/yy H:mm:ss", "M/d/yy")
LONG_YEAR = ("M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
EXTRA = ("yyyy-MM-dd HH:mm:ss",)
_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_WORD = r"^\s*[+-]?(?i:nan|inf|infinity)"


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def parse_ts(s: Column, extra: bool = False) -> Column:
    """TIMESTAMP_NTZ of a date text; two-digit years from 69 on are of the last century.

    ``extra`` reads whatever else is an ISO-like date or time of a day, with or without seconds.
    """
    t = trimmed(s)
    read = lambda f: F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz")
    short = F.coalesce(*[read(f) for f in SHORT_YEAR])
    short = F.when(F.year(short) >= 2069, short - F.expr("INTERVAL 100 YEARS")).otherwise(short)
    more = [*[read(f) for f in EXTRA], t.try_cast("timestamp_ntz")] if extra else []
    return F.coalesce(short, *[read(f) for f in LONG_YEAR], *more)


def parse_day(s: Column) -> Column:
    return parse_ts(s).cast("date")


def parse_amount_prefix(s: Column) -> Column:
    """DOUBLE of the longest numeric prefix; ``nan`` and ``inf`` words read as such."""
    word = F.lower(F.regexp_extract(s, r"^\s*([+-]?(?i:nan|inf))", 1))
    special = F.when(word.endswith("nan"), F.lit(float("nan"))).when(word == "-inf", F.lit(float("-inf"))).when(word.endswith("inf"), F.lit(float("inf")))
    number = F.nullif(F.regexp_extract(s, _PREFIX, 1), F.lit("")).try_cast("double")
    return F.when(s.rlike(_WORD), special).otherwise(F.when(F.abs(number) < float("inf"), number))


def parse_amount_whole(s: Column) -> Column:
    """DOUBLE of a text that is a number as a whole: no type letters behind it; ``inf`` words read as such, ``nan`` as null."""
    t = trimmed(s)
    endless = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), t.try_cast("double")).when(t.rlike(r"^[+-]?(?i:inf|infinity)$"), endless)


def fixed(x: Column, places: int) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{places}f", x)
