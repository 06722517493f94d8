"""From signals to totals, confidence, explanations and admission."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur import lexicon as L
from larkspur.settings import SETTINGS


def total() -> Column:
    """Not rounded: what is shown is, after admission and order."""
    out = F.lit(0.0)
    for name, w in SETTINGS.weights.items():
        out = out + F.col(name) * w
    return out


def confidence() -> Column:
    return F.round(raw_confidence(), 4)


def raw_confidence() -> Column:
    t = F.col("total")
    strong = F.when(F.col("phrase") >= 1.2, F.least(F.lit(0.99), 0.7 + t / 4.0)).when((F.col("fuzzy") >= 0.9) & (F.col("semantic") >= 0.3), F.least(F.lit(0.95), 0.62 + t / 4.5))
    return strong.otherwise(F.greatest(F.lit(0.15), F.least(F.lit(0.9), 0.35 + t / 5.0)))


def evidence() -> Column:
    return (F.col("matched") >= 2) | (F.col("title_bm25") > 0) | (F.col("phrase") > 0) | (F.col("fuzzy") >= 0.72) | (F.col("semantic") >= SETTINGS.semantic_rescue + 0.04) | (F.col("phonetic") >= 0.5)


def rescue() -> Column:
    near = (F.col("matched") > 0) | (F.col("fuzzy") >= 0.55) | (F.col("phonetic") >= 0.34) | (F.col("title_bm25") > 0)
    return (F.col("fuzzy") >= SETTINGS.fuzzy_rescue) | ((F.col("semantic") >= SETTINGS.semantic_rescue) & near) | (F.col("phrase") > 0)


def admitted() -> Column:
    return ((F.col("total") > SETTINGS.min_candidate) & evidence()) | rescue()


def explanations() -> Column:
    e = L.EXPLANATIONS
    return F.array_compact(F.array(
        F.when(F.col("phrase") >= 1.2, e["title"]).when(F.col("phrase") > 0, e["phrase"]), F.when(F.col("lexical") > 0, e["lexical"]), F.when(F.col("fuzzy") >= 0.8, e["fuzzy"]),
        F.when(F.col("semantic") >= 0.4, e["semantic"]), F.when(F.col("language_boost") > 0, e["language"]),
    ))
