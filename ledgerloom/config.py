"""Settings of a reconciliation and the two presets."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    """What makes a bank row and a journal entry a candidate, and how pairs are chosen.

    day_rule: ``calendar`` (whole days between dates) or ``floor`` (the floor of
    the exact difference in days, from -day_window to day_window).
    description: how an entry's lines give its text, ``concat`` or ``first``.
    entry_order: ``first_seen`` or ``key``; it defines gl_idx.
    null_keys: keep lines without a journal id as an entry of their own.
    bad_amount_zero: an unreadable ledger amount counts as 0, else it is skipped.
    total: how an entry's amounts add up: ``ordered`` (doubles, one after the other
    in line order), ``compensated`` (the same with Kahan's compensation) or
    ``decimal`` (cents as decimals, which combine before the shuffle; amounts are
    rounded to cents, and those from 1e15 on make the entry's amount null).
    """

    tolerance: float = 0.1
    day_window: int = 15
    day_rule: str = "calendar"
    need_description: bool = False
    nan_text: bool = False
    similarity: str = "jaccard"
    matcher: str = "greedy"
    description: str = "concat"
    entry_order: str = "first_seen"
    null_keys: bool = True
    bad_amount_zero: bool = True
    prefix_numbers: bool = True
    total: str = "ordered"
    round_output: bool = True

    @property
    def bucket_width(self) -> float:
        """At least 4 tolerances, so that a padded interval touches two buckets at most."""
        return 1.0 if self.tolerance <= 0.1 else 10 * self.tolerance


GREEDY = MatchConfig()
MAXFLOW = MatchConfig(tolerance=0.01, day_rule="floor", need_description=True, similarity="indel", matcher="max_cardinality", description="first", entry_order="key", null_keys=False, bad_amount_zero=False, prefix_numbers=False, total="compensated", round_output=False)
