"""Similarity of names: token-sorted, normalised indel similarity in percent, 200 LCS / (len + len)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from attestor.functions.text import words


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.array_sort(words(x)), " ")


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows (Hyyrö, 2004)."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & at.get(c, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def score(a: str, b: str) -> float:
    """Of token-sorted strings; 100 for two empty ones."""
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


#: Strings of up to so many characters are compared a batch at a time.
SHORT = 256


def masks(same: np.ndarray) -> np.ndarray:
    """Rows of booleans (a multiple of 64 wide) as words of 64 bits, the first the lowest."""
    return np.packbits(same, axis=1, bitorder="little").view(np.uint64)


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """lcs_length of each pair of strings, without NUL characters and of up to SHORT others, all pairs a character further in each step.

    A row of the table is held as words of 64 bits for each pair; where a word's addition overflows it is carried to the next.
    """
    n = len(a)
    letters = lambda x, width: np.array(x, dtype=f"<U{width}").view(np.uint32).reshape(n, width)
    wide = -(-max(max(map(len, a), default=1), 1) // 64) * 64
    of_a, of_b = letters(a, wide), letters(b, max(max(map(len, b), default=1), 1))
    row = np.full((n, wide // 64), ~np.uint64(0))
    for j in range(of_b.shape[1]):
        match = masks((of_a == of_b[:, j : j + 1]) & (of_b[:, j : j + 1] != 0))
        carry = np.zeros(n, np.uint64)
        for w in range(row.shape[1]):
            was, hit = row[:, w].copy(), row[:, w] & match[:, w]
            part = was + hit
            total = part + carry
            carry = ((part < was) | (total < part)).astype(np.uint64)
            row[:, w] = total | (was & ~match[:, w])
    zeros = np.bitwise_count(~row).sum(axis=1)
    return zeros.astype(np.int64)


def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Score of two columns in Arrow batches; a null gives null. Short strings of a batch are compared together, longer ones pair by pair."""
    tidy = lambda x: None if x is None else " ".join(sorted(x.split()))
    x, y = [tidy(v) for v in a], [tidy(v) for v in b]
    out = np.full(len(x), np.nan)
    plain = lambda s: len(s) <= SHORT and "\0" not in s
    there = [i for i in range(len(x)) if x[i] is not None and y[i] is not None]
    short = sorted((i for i in there if plain(x[i]) and plain(y[i])), key=lambda i: max(len(x[i]), len(y[i])))
    for start in range(0, len(short), 2048):  # of like lengths
        at = short[start : start + 2048]
        total = np.array([len(x[i]) + len(y[i]) for i in at])
        out[at] = np.where(total > 0, 200.0 * lcs_lengths([x[i] for i in at], [y[i] for i in at]) / np.maximum(total, 1), 100.0)
    for i in set(there) - set(short):
        out[i] = score(x[i], y[i])
    found = pd.Series(out, dtype="float64")
    return found.astype(object).where(found.notna(), None) if found.isna().any() else found


def token_sort_ratio_udf():
    """The Arrow-batched function for columns."""
    return F.pandas_udf(token_sort_ratio, "double")


def register(spark: SparkSession) -> None:
    """Make token_sort_ratio(a, b) known to SQL."""
    spark.udf.register("token_sort_ratio", token_sort_ratio_udf())


def token_sort_ratio_native(a: Column, b: Column) -> Column:
    """The same score by higher-order functions alone: one row of the LCS table folded over the other string."""
    x, y = F.split(sorted_tokens(a), ""), F.split(sorted_tokens(b), "")
    x, y = (F.filter(v, lambda c: c != "") for v in (x, y))
    zero = F.transform(F.sequence(F.lit(0), F.size(y)), lambda _: F.lit(0))

    def line(above: Column, c: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            best = F.when(F.element_at(y, j) == c, F.element_at(above, j) + 1).otherwise(F.greatest(F.element_at(above, j + 1), F.element_at(row, j)))
            return F.concat(row, F.array(best))

        return F.when(F.size(y) == 0, above).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(y), F.lit(1))), F.array(F.lit(0)), cell))

    lcs = F.element_at(F.aggregate(x, zero, line), -1)
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs / total)
