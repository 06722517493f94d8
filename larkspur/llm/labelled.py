"""Labelled rows for fitting: a bounded, documented sample, the same for every run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.blocks import checkpointed


def fold(id: str, n: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` when divided by n."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(n)) == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """text and label of at most ``most`` rows: one for each of the labelled ids of least hash, equal texts once.

    Where an id, or a text, is labelled twice, the larger label holds; of rows that share an id the one whose text
    has the least hash counts. The sample's ids are broadcast; their number is bounded by ``most``, and so is that
    of the rows that come back.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(id), id).limit(most).withColumnRenamed(id, "labelled_id")
    rows = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("labelled_id"))
    one = rows.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label"))
    return checkpointed(one.groupBy("text").agg(F.max("label").alias("label")))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the intercept first) by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
