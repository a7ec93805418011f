"""Token-set similarity of two names, 0 to 100."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Workers get this code with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step per letter."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, letter in enumerate(a):
        where[letter] = where.get(letter, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for letter in b:
        hit = free & where.get(letter, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def token_set_score(left: str | None, right: str | None) -> float:
    """Best of: both whole names, and the shared words against each whole name.

    Similarity is 100 * (1 - insertions and deletions / total length).  A name
    whose words all occur in the other scores 100.
    """
    a, b = set((left or "").split()), set((right or "").split())
    if not a or not b:
        return 0.0
    shared = " ".join(sorted(a & b))
    only_a, only_b = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if shared and (not only_a or not only_b):
        return 100.0
    joint = len(shared) + (1 if shared else 0)
    whole_a, whole_b = joint + len(only_a), joint + len(only_b)
    edits = len(only_a) + len(only_b) - 2 * common_subsequence(only_a, only_b)
    scores = [100.0 - 100.0 * edits / (whole_a + whole_b)]
    if shared:
        for whole, rest in ((whole_a, only_a), (whole_b, only_b)):
            scores.append(100.0 - 100.0 * (1 + len(rest)) / (len(shared) + whole))
    return max(scores)


def common_subsequences(left: list[str], right: list[str]) -> np.ndarray:
    """``common_subsequence`` of many pairs at once: one machine word per pair, one step per letter of the longest."""
    out = np.zeros(len(left), np.int64)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right)]
    short = [i for i, (a, _) in enumerate(pairs) if 0 < len(a) <= 64]
    for i, (a, b) in enumerate(pairs):
        if len(a) > 64:
            out[i] = common_subsequence(a, b)
    if not short:
        return out
    rows, columns = (_letters([pairs[i][k] for i in short]) for k in (0, 1))
    powers = np.uint64(1) << np.arange(rows.shape[1], dtype=np.uint64)
    free = np.full(len(short), np.iinfo(np.uint64).max, np.uint64)
    for j in range(columns.shape[1]):
        hit = free & ((rows == columns[:, j:j + 1]) * powers).sum(1, dtype=np.uint64)
        free = (free + hit) | (free & ~hit)
    sizes = np.array([len(pairs[i][0]) for i in short], np.uint64)
    inside = np.iinfo(np.uint64).max >> (np.uint64(64) - sizes)
    out[short] = sizes.astype(np.int64) - np.bitwise_count(free & inside).astype(np.int64)
    return out


def _letters(texts: list[str]) -> np.ndarray:
    """Letters as numbers, one text per row; what a text lacks is 0, which no name contains."""
    return np.array(texts).view(np.uint32).reshape(len(texts), -1)


def token_set_scores(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """``token_set_score`` of many pairs at once."""
    shared, only_a, only_b, out = [], [], [], np.zeros(len(left))
    at = []
    for i, (a, b) in enumerate(zip(left, right)):
        a, b = set((a or "").split()), set((b or "").split())
        if not a or not b:
            continue
        both = a & b
        if both and (a <= b or b <= a):
            out[i] = 100.0
            continue
        at.append(i)
        shared.append(sum(map(len, both)) + len(both) - 1 if both else 0)
        only_a.append(" ".join(sorted(a - both)))
        only_b.append(" ".join(sorted(b - both)))
    if not at:
        return out
    joint = np.array(shared) + (np.array(shared) > 0)
    rest_a, rest_b = np.array([len(x) for x in only_a]), np.array([len(x) for x in only_b])
    whole = 2 * joint + rest_a + rest_b
    scores = 100.0 - 100.0 * (rest_a + rest_b - 2 * common_subsequences(only_a, only_b)) / whole
    for rest in (rest_a, rest_b):
        scores = np.where(joint > 0, np.maximum(scores, 100.0 - 100.0 * (1 + rest) / (np.array(shared) + joint + rest)), scores)
    out[at] = scores
    return out


@F.pandas_udf(DoubleType())
def token_set_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(token_set_scores(left.tolist(), right.tolist()), dtype="float64")
