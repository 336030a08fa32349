"""Fuzzy similarity of short texts: sorted words, then twice the longest common subsequence over both lengths."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        both = row & where.get(c, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def sorted_words(text: str | None) -> str:
    return " ".join(sorted((text or "").split()))


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """0 to 100; 100 for two empty texts."""
    x, y = sorted_words(a), sorted_words(b)
    return 200.0 * _common(x, y) / (len(x) + len(y)) if x or y else 100.0


def report_form(text: str | None) -> str:
    """What the duplicate report compares: lower case, hyphens and underscores as single spaces."""
    return re.sub(r"\s+", " ", re.sub(r"[-_]+", " ", (text or "").lower().strip()))


def similarity(a: Column | str, b: Column | str) -> Column:
    """token_sort_ratio of two columns, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_sort_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def report_similarity(a: Column | str, b: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_sort_ratio(report_form(p), report_form(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def length_bound(a: Column | str, b: Column | str) -> Column:
    """No pair is more similar than this: the common part is no longer than the shorter text."""
    n, m = (F.char_length(F.col(c) if isinstance(c, str) else c) for c in (a, b))
    return F.when(n + m == 0, 100.0).otherwise(F.lit(200.0) * F.least(n, m) / (n + m))
