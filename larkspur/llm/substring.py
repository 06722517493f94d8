"""Operator 1, substring dedup: words covered by a repeated window of words are removed.

Every window of ``window`` words gets its Rabin-Karp hash; Spark counts the hashes (see
``blocks``); windows that occur at least twice, in one document or in several, merge into
maximal removal intervals. Windows are judged on the input, not on what is left.

Defined results: a null or empty text has no words, nothing is removed and the kept text is empty;
a text shorter than the window stays as it is (words joined by one space); repeated rows are
separate documents, so their windows repeat; a null id is an ordinary value; an empty table
gives an empty table; other columns are handed through, and one that has the name of an
output column is replaced by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import blocks as B
from larkspur.llm import kernels as K
from larkspur.llm.session import documents

BUCKET_BYTES = 24 << 20
OUTPUT = ["n_words", "n_removed", "spans"]


def window_pairs(t: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of every window of a block."""
    w, at = K.words(*K.text_buffer(t["text"]))
    ok = K.inside(at, len(w), window)
    return K.window_hashes(w, window, K.WORD_BASE)[ok], K.window_hashes(w, window, K.WORD_BASE_2)[ok]


def covered(t: pa.Table, again: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a block are covered, and the offsets of each document's words."""
    w, at = K.words(*K.text_buffer(t["text"]))
    hit = np.flatnonzero(K.inside(at, len(w), window))
    hit = hit[K.member(K.window_hashes(w, window, K.WORD_BASE)[hit], again)]
    step = np.zeros(len(w) + 1, dtype=np.int32)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + window, -1)
    return np.cumsum(step[:-1]) > 0, at


def intervals(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def substring_dedup(docs: DataFrame, window: int = 35, id: str = "doc_id", text: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """All columns of docs, the text being what is kept, and n_words, n_removed, spans (word ranges removed)."""
    total = B.size_of(docs, text)
    docs_b = B.blocked(docs, id, text, B.n_blocks(total, block_bytes))
    again = B.repeated_hashes(docs_b, lambda t: window_pairs(t, window), max(16, math.ceil(total * 1.4 / BUCKET_BYTES)))

    def finish(t: pa.Table, back: pa.Table) -> pa.Table:
        mask, at = covered(t, B.gathered(back), window)
        n, removed, spans, kept = [], [], [], []
        for i, x in enumerate(t["text"].to_pylist()):
            own = mask[at[i] : at[i + 1]]
            parts = (x or "").encode().split()
            n.append(len(own))
            removed.append(int(own.sum()))
            spans.append(intervals(own) if removed[-1] else [])
            kept.append(b" ".join([p for p, gone in zip(parts, own.tolist(), strict=True) if not gone] if removed[-1] else parts))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table([t["id"], t["rest"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "rest", *OUTPUT, "text"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("rest", B.struct_type(docs_b)), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("text", T.StringType())])
    out = docs_b.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(B.releasing_both(finish), schema)
    return B.unwrapped(out, docs, id, text, OUTPUT)


def deduplicated(docs: DataFrame, window: int = 35, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the kept words as their text; same columns, and n_chars, if it is one, the length of that text."""
    plain, names = B.numbered(docs)
    out = substring_dedup(plain, window, names[id], names[text])
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.length(names[text]).cast(docs.schema["n_chars"].dataType))
    return B.restored(out, docs, names)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
