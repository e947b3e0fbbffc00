"""Text ratios without a built-in form, as Arrow functions for pairs that a join has already narrowed."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit sets: bit j is 0 where column j grew."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for j, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << j
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@F.pandas_udf(DoubleType())
def subsequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * common subsequence / both lengths (TXT8); 1 for two empty texts, null for a null."""
    one = lambda x, y: None if x is None or y is None else 1.0 if not x and not y else 2 * _common(x, y) / (len(x) + len(y))
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks (TXT9)."""
    one = lambda x, y: None if x is None or y is None else SequenceMatcher(None, x, y).ratio()
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
