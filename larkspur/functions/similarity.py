"""String similarities from 0 to 1 as Arrow functions: Indel ratio, best window, token sets, and a stdlib fallback."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bit-parallel recurrence."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for x in b:
        u = s & where.get(x, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def indel(a: str | None, b: str | None) -> float:
    return 2 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial(a: str | None, b: str | None) -> float:
    """The best ratio of the shorter with any window, prefix or suffix of the longer of at most its length."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, best = len(short), 0.0
    for i in range(1 - n, len(long)):
        best = max(best, indel(short, long[max(i, 0) : i + n]))
        if best == 1.0:
            break
    return max(best, max((indel(long, short[max(i, 0) : i + n]) for i in range(1 - n, n)), default=0.0)) if len(a) == len(b) else best


def token_set(a: str | None, b: str | None) -> float:
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    gap = bool(both)
    la, lb = len(both) + gap + len(left), len(both) + gap + len(right)
    same = len(both) + gap
    whole = 2 * (same + common(left, right)) / (la + lb)
    return max([whole] + ([2 * len(both) / (len(both) + la), 2 * len(both) / (len(both) + lb)] if both else []))


def sequence(a: str | None, b: str | None) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _udf(f):
    @F.pandas_udf(T.DoubleType())
    def own(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return own


indel_ratio, partial_ratio, token_set_ratio, sequence_ratio = map(_udf, (indel, partial, token_set, sequence))


def register(spark) -> None:
    """The functions under their SQL names."""
    for name, f in (("indel_ratio", indel_ratio), ("partial_ratio", partial_ratio), ("token_set_ratio", token_set_ratio), ("sequence_ratio", sequence_ratio)):
        spark.udf.register(name, f)
