"""Similarity of strings by common subsequences, a batch of rows at a time."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights of the compared forms (fixed values): sorted or deduplicated words count a little less, parts of a longer string by how much longer it is.
WORDS_WEIGHT, PART_WEIGHT, SHORT_PART_WEIGHT, PART_FROM, SHORT_FROM = 0.95, 0.9, 0.6, 1.5, 8.0


def places(a: str) -> dict[str, int]:
    """Bits of the places where each letter of a stands."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    return where


def common(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit vectors: a letter of b is one step over all of a."""
    where = places(a) if where is None else where
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, 0 to 100; two empty strings are equal."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str, b: str) -> float:
    """The best similarity of the shorter string with a part of the longer one that is no longer than it."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, where = len(a), places(a)
    # a part has no more letters in common than it has of each letter of a; parts over an edge are shorter
    spare, shared, bounds = Counter(a), 0, []
    for end in range(1, len(b) + n):
        if end <= len(b):
            c = b[end - 1]
            shared += spare[c] > 0
            spare[c] -= 1
        if end > n:
            c = b[end - n - 1]
            spare[c] += 1
            shared -= spare[c] > 0
        bounds.append((200.0 * shared / (n + min(end, len(b)) - max(0, end - n)), end))
    best = 0.0
    for bound, end in sorted(bounds, reverse=True):
        if bound <= best:
            break
        part = b[max(0, end - n) : end]
        best = max(best, 200.0 * common(a, part, where) / (n + len(part)))
    if len(a) == len(b):
        best = max(best, partial_of_equals(b, a))
    return best


def partial_of_equals(a: str, b: str) -> float:
    """For strings of one length either may lie over the other's edge."""
    letters = set(a)
    return max((indel(a, p) for i in range(1, len(a)) for p in (b[:i], b[-i:]) if p[0] in letters or p[-1] in letters), default=0.0)


def words_ratio(a: str, b: str, ratio=indel) -> float:
    """Similarity whatever the order of words, or of what is left of either beside the words that both have."""
    x, y = sorted(a.split()), sorted(b.split())
    both, only_x, only_y = sorted(set(x) & set(y)), sorted(set(x) - set(y)), sorted(set(y) - set(x))
    ordered = ratio(" ".join(x), " ".join(y))
    if ratio is partial:
        return 100.0 if both else max(ordered, partial(" ".join(only_x), " ".join(only_y)))
    if not x or not y:
        return 0.0
    if both and (not only_x or not only_y):
        return 100.0
    shared, left, right = " ".join(both), " ".join([*both, *only_x]), " ".join([*both, *only_y])
    return max(ordered, indel(left, right), *((indel(shared, left), indel(shared, right)) if both else ()))


def weighted(a: str | None, b: str | None) -> float:
    """The best of several comparisons, weighted: as they stand, words in any order, and parts where one is much longer. Null or empty: 0. Case counts."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < PART_FROM:
        return max(indel(a, b), words_ratio(a, b) * WORDS_WEIGHT)
    part = PART_WEIGHT if longer <= SHORT_FROM else SHORT_PART_WEIGHT
    return max(indel(a, b), partial(a, b) * part, words_ratio(a, b, partial) * WORDS_WEIGHT * part)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel similarity of whole texts; null where either is."""
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted(x, y) for x, y in zip(a, b)], dtype="float64")

