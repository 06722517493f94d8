"""Operator 6, toxicity: maximum-scoring segments over token log-odds.

Fitting counts, in labelled documents (equal texts once), how many of either class hold each
token; beginnings of 5 and 7 bytes count as tokens of their own, for what a word begins with may
tell more than rare whole words. A token's score is its log-odds ratio under an informative
Dirichlet prior (the pooled share of the token), brought towards 0 by some standard errors; it may
be of either sign, and tokens of fewer than some documents have 0. A word has that of its three
scores which is largest in size, less a drift that makes the expected score on clean text negative.
A linear-time scan then finds every maximal scoring segment. Under that condition the best segment
of n clean tokens follows an extreme-value law with a decay ``lam`` that solves
sum p * exp(lam * score) = 1 over the words of clean text, so a segment of score S is expected
n * exp(-lam * S) times by chance; the score of a document is a logistic function of the logarithm
of that number, fitted on the same labelled documents.

Fitting uses at most ``max_docs`` labelled documents; scoring covers every whole text.

Defined results: a null or empty text scores as the best segment 0 of no tokens, without
passages; repeated rows score alike; with no labelled rows, or one class only, every score is
0.5 or the class's share; an empty table gives an empty one; other columns are handed through,
those named like an output column being replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import blocks as B
from larkspur.llm import kernels as K
from larkspur.llm.labelled import fold, logistic, sample
from larkspur.llm.session import documents

MAX_DOCS = 30_000
#: Bytes of a word that count; 0: all.
BEGINNINGS = (0, 5, 7)
PRIOR = 20.0
#: Documents that a token needs to have a score of its own, standard errors taken off, and the largest size.
LEAST_DOCS = 4
ERRORS = 2.5
MOST = 8.0
#: The mean score of clean words is at least so far below 0.
DRIFT = 0.1
PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes
    scores: np.ndarray
    drift: float
    lam: float
    weights: np.ndarray  # of the logistic function

    def probability(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """From the best segment's score and the number of tokens."""
        z = self.weights[0] + self.weights[1] * evidence(self.lam, best, n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(lam: float, best: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Minus the logarithm of the expected number of chance segments of this score, bounded for the fit."""
    return np.clip(lam * best - np.log(n + 1.0), -20, 40)


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and their beginnings (a row for each of BEGINNINGS), and the offsets of each document's."""
    buf, offsets = K.text_buffer(column)
    found = [K.words(buf, offsets, lower=True, separators=K.NOT_ALNUM, first=n) for n in BEGINNINGS]
    return np.stack([K.mix(h + np.uint64(n)) for (h, _), n in zip(found, BEGINNINGS, strict=True)]), found[0][1]


def token_scores(hashes: np.ndarray, model: Model) -> np.ndarray:
    """The score of each word, from a row of hashes for each of BEGINNINGS."""
    out = np.zeros(hashes.shape)
    if len(model.tokens):
        at = np.searchsorted(model.tokens, hashes)
        at[at == len(model.tokens)] = 0
        hit = model.tokens[at] == hashes
        out[hit] = model.scores[at[hit]]
    return np.take_along_axis(out, np.abs(out).argmax(axis=0)[None], axis=0)[0] - model.drift


def best_segment(s: np.ndarray) -> float:
    if not len(s):
        return 0.0
    total = np.concatenate([[0.0], np.cumsum(s)])
    return float((total - np.minimum.accumulate(total)).max())


def maximal_segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by the linear-time stack scan of Ruzzo and Tompa."""
    out: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    before = np.concatenate([[0.0], np.cumsum(s)])
    for i in np.flatnonzero(s > 0).tolist():
        seg = (i, i + 1, float(before[i]), float(before[i + 1]))
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= seg[2]:
                j -= 1
            if j < 0 or out[j][3] >= seg[3]:
                out.append(seg)
                break
            seg = (out[j][0], seg[1], out[j][2], seg[3])
            del out[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in out]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS) -> Model:
    """``labels`` has (id, label 0 or 1); rows that must not be learnt from are to be left out of it."""
    rows = sample(docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), labels.select(F.col(id).alias("doc_id"), F.col(label).alias(label)), label, max_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.rebatched(batches, "text"):
            h, at = tokens(b.column(0))
            y = b.column(1).to_numpy()
            doc = np.tile(np.repeat(np.arange(len(y)), np.diff(at)), len(h))
            h = h.ravel()
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            first = np.ones(len(h), dtype=bool)
            first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            token, where = np.unique(h, return_inverse=True)
            n = [np.bincount(where[m], minlength=len(token)) for m in (first & (y[doc] == 0), first & (y[doc] == 1))]
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in n)], names=["token", "y0", "y1"])

    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), DRIFT, 1.0, np.array([0.0 if not n0 + n1 else (30.0 if n1 else -30.0), 0.0]))
    counts = rows.mapInArrow(B.streaming(count), "token long, y0 long, y1 long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("y0", "y1")))
    both = F.col("y0") + F.col("y1")
    counts = counts.where(both >= LEAST_DOCS).withColumn("a", F.lit(PRIOR) * both / F.lit(n0 + n1))
    odds = lambda y, m: F.log((F.col(y) + F.col("a")) / (F.lit(m + PRIOR + 0.5) - F.col(y) - F.col("a")))
    counts = counts.withColumn("d", odds("y1", n1) - odds("y0", n0))
    error = F.sqrt(1 / (F.col("y1") + F.col("a")) + 1 / (F.col("y0") + F.col("a")))
    shrunk = F.signum("d") * F.least(F.abs("d") - ERRORS * error, F.lit(MOST))
    # As many rows as the bounded sample has tokens of LEAST_DOCS documents that tell something.
    known = counts.where(F.abs("d") > ERRORS * error).select("token", shrunk.alias("s")).collect()
    known.sort(key=lambda r: np.array(r["token"], dtype=np.int64).view(np.uint64))
    model = Model(np.array([r["token"] for r in known], dtype=np.int64).view(np.uint64), np.array([r["s"] for r in known], dtype=np.float64), 0.0, 1.0, np.zeros(2))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.rebatched(batches, "text"):
            v, c = np.unique(np.rint(token_scores(tokens(b.column(0))[0], model) * 1000).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(c.astype(np.int64))], names=["v", "c"])

    # Thousandths from -MOST to MOST: a bounded number of rows.
    clean = rows.where("label = 0").mapInArrow(B.streaming(histogram), "v long, c long").groupBy("v").agg(F.sum("c").alias("c")).orderBy("v").collect()
    v, c = np.array([r["v"] for r in clean]) / 1000.0, np.array([r["c"] for r in clean], dtype=np.float64)
    share = c / max(c.sum(), 1.0)
    model.drift = DRIFT + max(0.0, float((v * share).sum()))
    model.lam = decay(v - model.drift, share)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.rebatched(batches, "text"):
            h, at = tokens(b.column(0))
            s = token_scores(h, model)
            best = [best_segment(s[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(np.diff(at)), b.column(1)], names=["best", "n", "label"])

    # At most max_docs rows of three numbers; in order, so that the fit is the same in every run.
    seen = rows.mapInArrow(B.streaming(measure), "best double, n long, label int").toPandas().sort_values(["best", "n", "label"])
    x = evidence(model.lam, seen["best"].to_numpy(), seen["n"].to_numpy())
    model.weights = logistic(x[:, None], seen["label"].to_numpy().astype(float))
    return model


def decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum p * exp(lam * score) = 1, by bisection; 1 where no score is positive or the mean isn't negative."""
    f = lambda x: float((share * np.exp(x * scores)).sum() - 1)
    if not (scores[share > 0] > 0).any() or (share * scores).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", significant: float = 0.01) -> DataFrame:
    """docs with score (0 to 1) and passages: word ranges that chance would give ``significant`` times at most."""
    fields = [f for f in docs.schema.fields if f.name not in ("score", "passages")]
    names = [f.name for f in fields]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in B.rebatched(batches, text):
            h, at = tokens(b.column(names.index(text)))
            s = token_scores(h, m)
            n = np.diff(at)
            best, found = np.zeros(len(n)), []
            for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                best[k] = best_segment(s[i:j])
                spans = []
                if n[k] * np.exp(-m.lam * best[k]) <= significant:
                    for x, y, z in maximal_segments(s[i:j]):
                        if (expected := float(n[k] * np.exp(-m.lam * z))) <= significant:
                            spans.append({"start": x, "end": y, "score": z, "expected": expected})
                found.append(spans)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(m.probability(best, n)), pa.array(found, kind)], names=[*names, "score", "passages"])

    return docs.select(names).mapInArrow(B.streaming(work), T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGES)]))


def trained(spark, sf_dir: str, held: int = 0) -> Model:
    """The model of the documents and labels of a folder, without the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold("doc_id", 5, held))
    return fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score_toxicity(docs, trained(spark, sf_dir))
    return out.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
