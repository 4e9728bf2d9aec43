"""JSON records and the printed summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import fixed


def json_lines(records: DataFrame) -> DataFrame:
    """One JSON object per record, nulls included."""
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(records: DataFrame, path: str) -> None:
    json_lines(records).write.mode("overwrite").text(path)


def record_text(records: DataFrame, rounded: bool = True) -> DataFrame:
    """Records as indented objects; amounts with 2 and the score with 6 decimals if rounded."""
    places = {"gl_amount": 2, "bank_amount": 2, "score": 6} if rounded else {}

    def field(c: str):
        value = fixed(F.col(c), places[c]) if c in places else F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x")), {"ignoreNullFields": "false"}), r"(?s)^\{\"x\":(.*)\}$", 1)
        return F.concat(F.lit(f'    "{c}": '), F.coalesce(value, F.lit("null")))

    return records.select(F.concat(F.lit("  {\n"), F.concat_ws(",\n", *[field(c) for c in records.columns]), F.lit("\n  }")).alias("value"))


def write_json_array(records: DataFrame, path: str, rounded: bool = True) -> int:
    """A JSON array in one local file, row by row from the executors; for results that a person reads."""
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("[\n")
        for row in record_text(records, rounded).toLocalIterator():
            out.write((",\n" if n else "") + row["value"])
            n += 1
        out.write("\n]\n" if n else "]\n")
    return n


def summary_lines(row) -> list[str]:
    """The five lines of a summary row."""
    return [f"GL entries:        {row['gl_entries']}", f"Bank transactions: {row['bank_transactions']}", f"Matched:           {row['matched']}", f"Bank match rate:   {row['bank_match_rate']:.1f}%", f"GL match rate:     {row['gl_match_rate']:.1f}%"]
