"""From two CSV files to matches and a summary."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..config import GREEDY, MAXFLOW, MatchConfig
from ..operators.candidates import candidates
from ..operators.ledger import aggregate_entries
from ..operators.matching import match
from ..operators.numbering import cut
from ..operators.report import records, summary
from ..sources.sinks import summary_lines, write_json_array
from ..sources.tables import bank_rows, ledger_lines, read_csv


@dataclass
class Reconciliation:
    bank: DataFrame
    entries: DataFrame
    pairs: DataFrame
    matches: DataFrame
    records: DataFrame
    summary: DataFrame


def reconcile(bank: DataFrame, entries: DataFrame, config: MatchConfig = GREEDY, strategy: str = "auto") -> Reconciliation:
    """Candidates, matching, records and rates of typed bank rows and entries."""
    pairs = cut(candidates(bank, entries, config))
    # Stored, as records and rates both read them.
    found = cut(match(pairs, config, strategy))
    return Reconciliation(bank, entries, pairs, found, records(found, bank, entries, config), summary(found, bank, entries))


def reconcile_csv(spark: SparkSession, bank_path: str, ledger_path: str, config: MatchConfig = GREEDY, strategy: str = "auto") -> Reconciliation:
    bank = bank_rows(read_csv(spark, bank_path), config)
    entries = aggregate_entries(ledger_lines(read_csv(spark, ledger_path), config), config)
    return reconcile(bank, entries, config, strategy)


def main(argv: list[str] | None = None) -> int:
    """``python -m ledgerloom.plans.pipeline [BANK LEDGER]`` writes matches.json and prints the summary.

    Without a file, or with an empty one, says so and gives 1.
    """
    args = argparse.ArgumentParser(description=main.__doc__)
    args.add_argument("paths", nargs="*")
    args.add_argument("--preset", choices=("greedy", "maxflow"), default="greedy")
    args.add_argument("--strategy", choices=("auto", "grouped", "rounds"), default="auto")
    args.add_argument("--out", default="matches.json")
    given = args.parse_args(argv)
    # One path alone does not override the defaults.
    bank, ledger = given.paths[:2] if len(given.paths) >= 2 else ("bank_transactions.csv", "general_ledger.csv")
    config = GREEDY if given.preset == "greedy" else MAXFLOW
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        done = reconcile_csv(spark, bank, ledger, config, given.strategy)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        print(f"Cannot open {bank} or {ledger}: {error.getMessageParameters().get('path', '')}", file=sys.stderr)
        return 1
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    write_json_array(done.records, given.out, config.round_output)
    print("\n".join(summary_lines(done.summary.first())))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
