"""Tokens and similarities of descriptions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def tokenize(s: Column) -> Column:
    """Distinct lower-cased runs of ASCII letters and digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda t: F.lower(t)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / F.when(union == 0, F.lit(1)).otherwise(union))


def concat_nonempty(parts: Column) -> Column:
    """An array's non-empty strings, joined by a space."""
    return F.array_join(F.filter(parts, lambda s: s.isNotNull() & (s != "")), " ")


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: b's rows as bits of one integer (Hyyro 2004)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def indel_similarity(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 1.0 if not total else 2.0 * _common_subsequence(a, b) / total


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (length + length), in code points; 1 if both are empty."""
    return pd.Series(np.fromiter((indel_similarity(x or "", y or "") for x, y in zip(a, b)), float, len(a)))
