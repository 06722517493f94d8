"""Blocks of documents, and counting their hashes in Spark without a row per hash.

Documents are dealt to blocks of a few megabytes by a hash of id and text. A block sends
its distinct hashes to buckets, packed; a bucket finds those that occur more than once and
tells the blocks that sent them. What one block sends of a hash is one value, however many
copies it holds, so a group of copies adds to a bucket by the number of blocks and not by
its size. Nothing is collected by the driver but the total size.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import kernels as K

BLOCK_BYTES = 8 << 20
ROWS_PER_TASK = 1 << 14
LEAST_BLOCKS = 64
COUNTS = "bucket int, block int, once binary, many binary"
RETURNED = "block int, hashes binary"


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_of(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0


def release() -> None:
    """Gives freed memory back to the system, as Spark keeps idle Python workers."""
    K.forget()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(f: Callable) -> Callable:
    """A function for groups, after each of which freed memory is given back."""

    @functools.wraps(f)
    def work(t: pa.Table) -> pa.Table:
        try:
            return f(t)
        finally:
            release()

    return work


def releasing_both(f: Callable) -> Callable:
    """The same for a function of two groups."""

    @functools.wraps(f)
    def work(t: pa.Table, other: pa.Table) -> pa.Table:
        try:
            return f(t, other)
        finally:
            release()

    return work


def streaming(f: Callable) -> Callable:
    """The same for a function of a task's batches, after the last one."""

    @functools.wraps(f)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return work


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the session names.

    Only where none is set, as in tests, one beside the warehouse is chosen.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint(eager=True)


def compacted(df: DataFrame) -> DataFrame:
    """A checkpoint of a table of short rows, read in as many tasks as its rows ask for.

    Each task of a step writes files of its own to a shuffle, however few rows it has; small tables
    that go through many steps would otherwise fill the disk with nearly empty files.
    """
    df = checkpointed(df)
    return df.coalesce(max(1, math.ceil(df.count() / ROWS_PER_TASK)))


def tidied(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of earlier rounds that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def blocked(docs: DataFrame, id: str, text: str, n_blocks: int) -> DataFrame:
    """block, id, text and the other columns as one struct, dealt by block.

    The struct keeps other columns apart from the operator's own, whatever their names.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id, text)]
    return docs.select(
        F.pmod(F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`")), F.lit(n_blocks)).cast("int").alias("block"),
        F.col(f"`{id}`").cast("long").alias("id"),
        F.col(f"`{text}`").cast("string").alias("text"),
        (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("rest"),
    ).repartition(width(docs.sparkSession), "block")


def n_blocks(total: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(LEAST_BLOCKS, math.ceil(total / block_bytes))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with plain numbers for names, which clash with no operator's, and each column's."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(out: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of docs under their own names."""
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def unwrapped(out: DataFrame, docs: DataFrame, id: str, text: str, added: list[str]) -> DataFrame:
    """The input's columns in their order, then those added; an added one replaces its namesake."""
    cols = []
    for f in docs.schema.fields:
        if f.name in added:
            continue
        if f.name == id:
            cols.append(F.col("id").cast(f.dataType).alias(id))
        elif f.name == text:
            cols.append(F.col("text").alias(text))
        else:
            cols.append(F.col("rest").getField(f.name).alias(f.name))
    return out.select(*cols, *[F.col(c) for c in added])


def in_order(t: pa.Table) -> pa.Table:
    """A block's rows by id (null last), then text; so each pass sees them alike."""
    return t.take(pc.sort_indices(t.select(["id", "text"]), sort_keys=[("id", "ascending"), ("text", "ascending")]))


def count_rows(block: int, hashes: np.ndarray, spread: np.ndarray, buckets: int) -> pa.Table:
    """What a block sends: per bucket its hashes, those it holds once and those it holds more often."""
    rows: dict[str, list] = {"bucket": [], "once": [], "many": []}
    for b, at in K.split_by((spread % np.uint64(buckets)).astype(np.int64)):
        value, count = np.unique(hashes[at], return_counts=True)
        rows["bucket"].append(b)
        rows["once"].append(K.pack(value[count == 1]))
        rows["many"].append(K.pack(value[count > 1]))
    n = len(rows["bucket"])
    return pa.table([pa.array(rows["bucket"], pa.int32()), pa.array([block] * n, pa.int32()), pa.array(rows["once"], pa.binary()), pa.array(rows["many"], pa.binary())], names=["bucket", "block", "once", "many"])


def repeated(t: pa.Table) -> pa.Table:
    """One bucket: which hashes are there twice, told to each block that has them."""
    once = [K.unpack(x) for x in t["once"].to_pylist()]
    many = [K.unpack(x) for x in t["many"].to_pylist()]
    every = np.sort(np.concatenate(once + many))
    again = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *many]))
    blocks, out = [], []
    for block, a, b in zip(t["block"].to_pylist(), once, many, strict=True):
        mine = np.concatenate([a[K.member(a, again)], b])
        if len(mine):
            blocks.append(block)
            out.append(K.pack(np.sort(mine)))
    return pa.table([pa.array(blocks, pa.int32()), pa.array(out, pa.binary())], names=["block", "hashes"])


def repeated_hashes(docs_b: DataFrame, hashes: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """block, hashes: the hashes of each block that occur at least twice anywhere.

    ``hashes`` takes a block and returns each hash and an independent one that picks the bucket,
    so the number of bits that tell two sequences apart grows with the number of buckets.
    """

    def send(t: pa.Table) -> pa.Table:
        return count_rows(t["block"][0].as_py(), *hashes(t), buckets)

    return docs_b.groupBy("block").applyInArrow(releasing(send), COUNTS).groupBy("bucket").applyInArrow(releasing(repeated), RETURNED)


def gathered(t: pa.Table) -> np.ndarray:
    """All hashes that were returned to a block, sorted."""
    return np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *(K.unpack(x) for x in t["hashes"].to_pylist())]))


def rebatched(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few megabytes of text, or one longer text."""
    for b in batches:
        _, offsets = K.text_buffer(b.column(b.schema.get_field_index(text)))
        for i, j in K.pieces(offsets, most):
            yield b.slice(i, j - i)


def struct_type(df: DataFrame) -> T.DataType:
    return df.schema["rest"].dataType
