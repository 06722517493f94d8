"""Operator 3, best-fit packing of token sequences, by hierarchical residual packing.

Pieces are dealt to partitions whatever their size. Each partition packs its pieces best-fit, longest first, into bins of the capacity and emits
those that are nearly full. The underfull bins become items, dealt anew to the nodes of the next
level, of which there are as many as a bounded number of bins a node asks for; they merge by
best-fit again, round after round, until one node has taken all that were left, or, where more
are left than a node takes, a round no longer lowers their number. A bin is found by its free
space in a bitmap, so an item costs O(1).

Ids are those of the tokenizer's plain call without special tokens at the ends; a string of an
added token inside a text is that token, as the call has it.

Defined results: a null text is empty, so it has the end id alone; a text that fits is never
cut; one that doesn't becomes pieces of the capacity, the first one taking the rest; repeated
rows are separate pieces; null ids are ordinary values; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import blocks as B
from larkspur.llm import kernels as K
from larkspur.llm.chunks import ChunkEncoder
from larkspur.llm.session import documents

CAPACITY = 2048
#: A bin with less room than this is nearly full.
NEARLY = 16
#: Items that a leaf packs at once, and bins that a node of the tree takes.
LEAF_ITEMS = 100_000
NODE_BINS = 16_384
#: The rounds end when one leaves more than this share of its underfull bins.
ROUND_LEFT = 0.999
#: Bytes of text that a worker encodes at once, and pieces that it sends at once.
BATCH_BYTES = 8 << 20
PIECES = 512


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each item, and what each bin holds."""
    bins = np.empty(len(sizes), dtype=np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, used = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = room >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                room &= ~(1 << free)
        else:
            free, b = capacity, len(used)
            used.append(0)
        used[b] += n
        bins[i] = b
        if free - n:
            by_free[free - n].append(b)
            room |= 1 << (free - n)
    return bins, np.array(used, dtype=np.int64)


def _bins(level: int, node: int, first: int, bins: np.ndarray, used: np.ndarray, sizes: np.ndarray, items: pa.Array) -> pa.RecordBatch:
    """A row for each bin, with its items; ``items`` is a list of structs for each packed row."""
    order = np.argsort(bins, kind="stable")
    taken = items.take(pa.array(order))
    count = np.bincount(bins, weights=np.diff(items.offsets.to_numpy()), minlength=len(used)).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), taken.flatten())
    ids = (level << 58) + (node << 28) + first + np.arange(len(used), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(used), node, dtype=np.int64)), pa.array(ids), pa.array(used.astype(np.int32)), lists], names=["node", "bin", "used", "items"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset; ``length`` is at least 1 and at most the capacity, and not null."""
    kept = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    item = T.StructType(kept)
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("used", T.IntegerType()), T.StructField("items", T.ArrayType(item))])
    names = [f.name for f in kept]

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, waiting, n = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).select(names).combine_chunks()
            sizes = t[length].to_numpy().astype(np.int64)
            structs = pa.StructArray.from_arrays([t[x].chunk(0) for x in names], fields=[t.schema.field(x) for x in names])
            one = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32)), structs)
            return _bins(0, node, first, *best_fit(sizes, capacity), sizes, one)

        for b in batches:
            if b.num_rows:
                waiting.append(b)
                n += b.num_rows
            if n >= LEAF_ITEMS:
                yield (out := packed())
                first, waiting, n = first + out.num_rows, [], 0
        if n:
            yield packed()

    def merged(level: int):
        def work(t: pa.Table) -> pa.Table:
            t = t.sort_by([("used", "descending"), ("bin", "ascending")]).combine_chunks()
            sizes = t["used"].to_numpy().astype(np.int64)
            lists = t["items"].chunk(0)
            return pa.Table.from_batches([_bins(level, t["node"][0].as_py(), 0, *best_fit(sizes, capacity), sizes, lists)])

        return work

    level, done, before = 0, [], None
    # Dealt round-robin, for a partition of long pieces would miss the short ones of another; few pieces to few leaves.
    now = B.checkpointed(pieces.hint("rebalance").mapInArrow(B.streaming(leaf), schema))
    while True:
        open_ = now.where(F.col("used") <= capacity - NEARLY)
        bins, nodes = open_.agg(F.count("*"), F.countDistinct("node")).first()
        if nodes <= 1 or (before is not None and bins > ROUND_LEFT * before):
            done.append(now)
            break
        # Bins are dealt anew by hash, so that each node has sizes of every kind.
        level, before = level + 1, bins
        fewer = max(1, math.ceil(bins / NODE_BINS))
        done.append(now.where(F.col("used") > capacity - NEARLY))
        now = B.checkpointed(open_.withColumn("node", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(fewer))).groupBy("node").applyInArrow(B.releasing(merged(level)), schema))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index("items"))
            at = lists.offsets.to_numpy()
            at = at - at[0]
            structs = lists.flatten()
            sizes = structs.field(names.index(length)).to_numpy().astype(np.int64)
            before = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(sizes) else sizes
            count = np.diff(at)
            base = np.repeat(before[at[:-1]], count) if len(sizes) else before
            bin_ = np.repeat(b.column(b.schema.get_field_index("bin")).to_numpy(), count)
            yield pa.RecordBatch.from_arrays([*structs.flatten(), pa.array(bin_, pa.int64()), pa.array(before - base, pa.int64())], names=[*names, "sequence_id", "offset"])

    return every.select("bin", "items").mapInArrow(placed, T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


_tokenizers: dict[int, Ids] = {}


class Ids:
    """Texts to the ids that the tokenizer's plain call gives, one for each worker.

    Texts that hold a string of the tokenizer's added tokens are encoded as they are, all others
    by their chunks.
    """

    def __init__(self, source: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_str(source)
        self.added = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
        self.chunks = ChunkEncoder(self.encoded)

    def encoded(self, words: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        end = 4 * np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        flat = np.fromiter(chain.from_iterable(ids), dtype="<u4", count=int(end[-1]) // 4 if len(end) else 0).tobytes()
        end = end.tolist()
        return [flat[a:b] for a, b in zip([0, *end], end, strict=False)]

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = buf.tobytes()
        if not any(x in data for x in self.added):
            return self.chunks(buf, offsets)
        parts = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            one = data[a:b]
            whole = any(x in one for x in self.added)
            parts.append(np.array(self.tokenizer.encode(one.decode(), add_special_tokens=False).ids, dtype="<u4") if whole else self.chunks(buf[a:b], np.array([0, b - a]))[0])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _ids(source: str) -> Ids:
    key = hash(source)
    if key not in _tokenizers:
        _tokenizers[key] = Ids(source)
    return _tokenizers[key]


def cut_up(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of n ids; all but the first are full."""
    count = -(-n // capacity)
    doc = np.repeat(np.arange(len(n)), count)
    piece = K.ranges(np.zeros(len(n), dtype=np.int64), count)
    first = (n - (count - 1) * capacity)[doc]
    return doc, piece, np.where(piece == 0, 0, first + (piece - 1) * capacity), np.where(piece == 0, first, capacity)


def token_pieces(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, piece, start, length and ids (little-endian 32-bit) of each document's pieces."""
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(sent.value)
        for b in B.rebatched(batches, "text", BATCH_BYTES):
            found, at = encode(*K.text_buffer(b.column(1)))
            n = np.diff(at) + 1
            base = np.cumsum(n) - n
            ids = np.full(int(n.sum()), end, dtype="<u4")
            ids[K.ranges(base, n - 1)] = found
            doc, piece, start, length = cut_up(n, capacity)
            whole = [b.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length)]
            for i in range(0, len(doc), PIECES):  # of bounded size, whatever a text's length
                j = min(i + PIECES, len(doc))
                lo, hi = int(base[doc[i]] + start[i]), int(base[doc[j - 1]] + start[j - 1] + length[j - 1])
                bounds = np.append(base[doc[i:j]] + start[i:j], hi) - lo
                data = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(ids[lo:hi].copy())])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in whole), data], names=["id", "piece", "start", "length", "ids"])
        encode.chunks.forget()

    only = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return only.mapInArrow(B.streaming(work), "id long, piece int, start long, length long, ids binary").withColumnRenamed("id", id)


def packed_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers as P

    pieces = token_pieces(docs, P.path("byte_bpe_50k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_digests(documents(spark, sf_dir))
