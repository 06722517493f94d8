"""Operator 9, quality classifier: a sparse rule ensemble compiled into Spark expressions.

Statistics of each text are computed from its bytes. Boosted shallow trees are fitted on a
bounded sample of labelled documents; every path from a root becomes a conjunctive rule over
the statistics; a logistic regression with a lasso penalty picks and weighs the rules; those
with a weight are compiled into Spark column expressions, which score all documents.

Defined results: a null text counts as empty, and an empty text has all statistics 0;
repeated rows score alike; with no labelled rows, or one class only, every score is 0.5 or
that class; an empty table gives an empty one; other columns are handed through, those named
like a statistic or an output column being replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import blocks as B
from larkspur.llm import kernels as K
from larkspur.llm.labelled import fold, sample
from larkspur.llm.session import documents

MAX_DOCS = 20_000
TREES = 40
DEPTH = 3
BINS = 32
LASSO = 4e-4
STATISTICS = [
    "q_bytes", "q_words", "q_word_bytes", "q_longest", "q_letters", "q_digits", "q_symbols", "q_spaces", "q_uppercase", "q_wide", "q_lines", "q_line_words", "q_distinct_words",
    "q_distinct_pairs", "q_distinct_lines", "q_top_word", "q_short_words", "q_symbol_words", "q_digit_words", "q_stops", "q_marks", "q_odd_marks", "q_brackets",
]
_IS = {
    "letters": np.array([chr(i).isalpha() and i < 128 or i >= 128 for i in range(256)]), "digits": np.array([48 <= i <= 57 for i in range(256)]),
    "symbols": np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)]), "uppercase": np.array([65 <= i <= 90 for i in range(256)]), "wide": np.array([i >= 192 for i in range(256)]),
    "stops": np.array([chr(i) in ".!?" for i in range(256)]), "marks": np.array([chr(i) in ",;:" for i in range(256)]), "odd": np.array([chr(i) in "#$%&*|~^=@+_" for i in range(256)]),
    "brackets": np.array([chr(i) in "<>{}[]()/\\" for i in range(256)]),
}


def distinct(h: np.ndarray) -> int:
    return len(np.unique(h))


def statistics_of(column) -> np.ndarray:
    """A row of STATISTICS for each text."""
    buf, offsets = K.text_buffer(column)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    starts, ends = K.word_spans(buf, offsets)
    h, at = K.words(buf, offsets)
    for i in range(len(out)):
        b = buf[offsets[i] : offsets[i + 1]]
        n = len(b)
        if not n:
            continue
        count = np.bincount(b, minlength=256)
        part = {k: float(count[m].sum()) for k, m in _IS.items()}
        w = h[at[i] : at[i + 1]]
        m = len(w)
        out[i, :2] = n, m
        if not m:
            out[i, 7] = 1.0
            continue
        s, e = starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]]
        size = e - s
        inner = buf[np.maximum(e - 2, s)]  # before a last mark
        lines = [x for x in b.tobytes().split(b"\n") if x.strip()]
        _, times = np.unique(w, return_counts=True)
        pairs = K.mix(w[:-1]) + w[1:]
        out[i, 2:] = (
            size.mean(), size.max(), part["letters"] / n, part["digits"] / n, part["symbols"] / n, float(count[K.SPACE].sum()) / n, part["uppercase"] / n, part["wide"] / n, len(lines), m / len(lines),
            len(times) / m, distinct(pairs) / len(pairs) if m > 1 else 1.0, len(set(lines)) / len(lines), times.max() / m, float((size <= 3).mean()), float((_IS["symbols"][inner] & (size > 1)).mean()),
            float(_IS["digits"][buf[s]].mean()), part["stops"] / m, part["marks"] / m, part["odd"] / m, part["brackets"] / m,
        )
    return out


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    fields = [f for f in docs.schema.fields if f.name not in STATISTICS]
    names = [f.name for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.rebatched(batches, text):
            x = statistics_of(b.column(names.index(text)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=[*names, *STATISTICS])

    return docs.select(names).mapInArrow(B.streaming(work), T.StructType([*fields, *(T.StructField(s, T.DoubleType()) for s in STATISTICS)]))


#: A rule: (statistic, True for "at most" or False for "above", threshold) of each condition.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score as a Spark expression over the statistics, its terms added in pairs: one chain of hundreds of rules overflows the planner's stack."""
        terms = [F.lit(self.intercept)]
        for rule, weight in self.rules:
            holds = F.lit(True)
            for j, at_most, t in rule:
                c = F.col(STATISTICS[j])
                holds = holds & ((c <= t) if at_most else (c > t))
            terms.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
        while len(terms) > 1:
            terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) - len(terms) % 2 :]
        total = terms[0]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, at_most, t in rule:
        out &= (x[:, j] <= t) if at_most else (x[:, j] > t)
    return out


def grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], step: np.ndarray) -> None:
    """Splits by the gain of gradients; adds each node's path as a rule, and each leaf's value to ``step``."""
    if path:
        rules.append(path)
    leaf = -g[rows].sum() / (h[rows].sum() + 1.0)
    best = (1e-3, None)
    if depth and len(rows) >= 20:
        gs, hs = g[rows].sum(), h[rows].sum()
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(binned[rows, j], weights=g[rows], minlength=len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], weights=h[rows], minlength=len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(binned[rows, j], minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < 8) | (len(rows) - nl < 8)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, k))
    if best[1] is None:
        step[rows] = leaf
        return
    j, k = best[1]
    left = binned[rows, j] <= k
    for side, at_most in ((rows[left], True), (rows[~left], False)):
        grow(binned, cuts, g, h, side, depth - 1, (*path, (j, at_most, float(cuts[j][k]))), rules, step)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    if not len(y) or y.min() == y.max():
        return RuleModel(0.0 if not len(y) else (30.0 if y[0] else -30.0), [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: list[Rule] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        grow(binned, cuts, p - y, p * (1 - p), np.arange(len(y)), depth, (), rules, step)
        f += 0.3 * step
    columns: dict[bytes, Rule] = {}
    for r in sorted(set(rules), key=lambda r: (len(r), r)):
        columns.setdefault(np.packbits(holds(r, x)).tobytes(), r)  # of rules that hold alike, the shortest
    chosen = list(columns.values())
    if not chosen:
        return RuleModel(float(f[0]), [])
    a = np.column_stack([holds(r, x) for r in chosen]).astype(np.float64)
    weights, intercept = lasso_logistic(a, y, lasso)
    return RuleModel(float(intercept), [(r, float(w)) for r, w in zip(chosen, weights, strict=True) if w])


def lasso_logistic(a: np.ndarray, y: np.ndarray, lasso: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the intercept bears no penalty."""
    n, k = a.shape
    mean = a.mean(0)
    c = a - mean
    lip = np.linalg.norm(c, 2) ** 2 / (4 * n) + 0.25
    w, v, t, b, bv = np.zeros(k), np.zeros(k), 1.0, np.log(y.mean() / (1 - y.mean())), 0.0
    bv = b
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(c @ v + bv, -30, 30))) - y
        new = v - (c.T @ r) / n / lip
        new = np.sign(new) * np.maximum(np.abs(new) - lasso / lip, 0)
        nb = bv - r.mean() / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bv = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, float(b - mean @ w)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS) -> RuleModel:
    """``labels`` has (id, label 0 or 1); rows that must not be learnt from are to be left out of it."""
    rows = sample(docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), labels.select(F.col(id).alias("doc_id"), F.col(label).alias(label)), label, max_docs)
    seen = with_statistics(rows).select("label", *STATISTICS).toPandas().sort_values(["label", *STATISTICS])  # at most max_docs rows of numbers
    return fit_rules(seen[STATISTICS].to_numpy(), seen["label"].to_numpy().astype(float))


def score_quality(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """docs with the statistics and score."""
    return with_statistics(docs, text).withColumn("score", model.column())


def trained(spark, sf_dir: str) -> RuleModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold("doc_id", 4, 2))
    return fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score_quality(docs, trained(spark, sf_dir))
    return out.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
