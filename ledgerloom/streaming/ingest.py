"""Bank rows and candidate pairs as streams.

Bank files that arrive in a folder are typed as in batch; pairs against a
static table of entries need no state, since an entry side is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import MatchConfig
from ..operators.candidates import candidates
from ..sources.tables import bank_rows

BANK_SCHEMA = "bank_id long, datetime string, amount string, description string"


def bank_stream(spark: SparkSession, folder: str, config: MatchConfig) -> DataFrame:
    """Typed bank rows of CSV files in a folder as they come; bank_id is their identity."""
    return bank_rows(spark.readStream.schema(BANK_SCHEMA).csv(folder, header=True, quote='"', escape='"'), config, index="bank_id")


def candidate_stream(bank: DataFrame, entries: DataFrame, config: MatchConfig) -> DataFrame:
    """Candidate pairs of streamed bank rows with a static table of entries."""
    return candidates(bank, entries, config)
