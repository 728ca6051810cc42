"""Name similarities that Spark lacks, for pairs that an equi-join has already blocked."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module's functions with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [b[j] for j, used in enumerate(taken) if used]
    # Half of the letters out of order, rounded down, as is usual.
    moved = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _jaro_winkler(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    base = _jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return base + prefix * 0.1 * (1 - base)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def leading_hits(term: Column, word: Column) -> Column:
    """Length of the longest leading part of ``term`` that occurs inside ``word``."""
    steps = F.sequence(F.lit(1), F.length(term))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda best, n: F.when(F.contains(word, F.substring(term, F.lit(1), n)), n).otherwise(best),
    )


def lastname_score(term: Column, word: Column) -> Column:
    """Share of the term found in order in the word, lowered by the difference in length."""
    hits = leading_hits(term, word).cast("double") / F.length(term)
    gap = F.abs(F.length(word) - F.length(term)) / F.greatest(F.length(term), F.length(word))
    return hits - gap * 0.5
