"""Indel-based fuzzy ratios, which Spark lacks, as Arrow-batched UDFs.

The longest common subsequence comes from a bit-parallel recurrence over Python integers, so one
comparison costs the length of one string in word-wide steps.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def _common(masks: dict[str, int], n: int, b: str) -> int:
    full = row = (1 << n) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _common(_masks(a), len(a), b)


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths; two empty texts are equal."""
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of its length in the longer, edges included.

    The shorter text's masks serve all windows, and windows that couldn't beat the best even if they
    matched whole are skipped.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n, masks, best = len(short), _masks(short), 0.0
    for k in range(1 - n, len(long)):
        window = long[max(0, k) : k + n]
        if 200.0 * len(window) / (n + len(window)) > best:
            best = max(best, 200.0 * _common(masks, n, window) / (n + len(window)))
    return best


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common tokens and each side's, sorted and joined."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and (not left or not right):
        return 100.0
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    return max(indel_ratio(one, two), *((indel_ratio(common, one), indel_ratio(common, two)) if common else (0.0,)))


def sequence_ratio(a: str, b: str) -> float:
    """The matching-blocks ratio, which stands in where no Indel ratio is wanted."""
    return 100.0 * SequenceMatcher(None, a, b).ratio()


def _udf(ratio):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        return pd.Series([known[p] if p in known else known.setdefault(p, ratio(*p)) for p in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")

    return run


fuzz_ratio, fuzz_partial_ratio, fuzz_token_set_ratio, fuzz_sequence_ratio = (_udf(f) for f in (indel_ratio, partial_ratio, token_set_ratio, sequence_ratio))
