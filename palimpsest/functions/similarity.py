"""String similarities. Python functions for Arrow UDFs, and native bounds that keep most pairs from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of a number."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float:
    """2 LCS / (length of both); an empty or missing string is like nothing."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 2 * lcs_length(a, b) / (len(a) + len(b))


def osa(a: str, b: str, limit: int) -> int:
    """Edits between a and b, a swap of neighbours counting once; limit + 1 beyond the limit."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row[j] = v
        if min(row) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


def indel_ratio_udf():
    @F.pandas_udf("double")
    def ratio(a, b):
        import pandas as pd

        return pd.Series([indel_ratio(x, y) for x, y in zip(a, b)])

    return ratio


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Native test that an indel ratio of `threshold` is possible: the difference of lengths and Spark's
    Levenshtein distance are lower bounds of the indel distance."""
    room = ((F.length(a) + F.length(b)) * F.lit(1 - threshold) + 1e-9).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= room) & (F.levenshtein(a, b) <= room)
