"""Operator 8, byte-level BPE encoding and decoding by a table of ranks.

Merging a pre-token uses a hierarchical-bitmap rank queue: per merge rank a bucket holds the
positions, in a linked list of parts, whose pair has this rank; three levels of 64-bit words
say which buckets have entries, so find-first-set on each level gives the lowest rank; entries
whose pair has changed meanwhile are stale and skipped when they come up. A pre-token of n
bytes costs O(n log n) whatever its length. Encodings of short chunks are kept (see ``chunks``).

Defined results: a null or empty text has no ids and decodes to no bytes; other columns are
handed through, one named like an output column being replaced by it; rows are independent,
so repeated rows get equal results and an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import blocks as B
from larkspur.llm import kernels as K
from larkspur.llm.chunks import ChunkEncoder
from larkspur.llm.session import documents

IDS = T.ArrayType(T.IntegerType())
Step = Callable[[pa.RecordBatch], pa.RecordBatch]
RANK_BITS = 20


def rank_table(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


class Encoder:
    """Encodes by ``lines`` of base64 token and rank, splitting text by ``pattern``."""

    def __init__(self, lines: bytes, pattern: str) -> None:
        self.ranks = rank_table(lines)
        size = max(self.ranks.values()) + 1
        if size > 1 << RANK_BITS:
            raise ValueError("too many ranks")
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        #: Two neighbours, as left << RANK_BITS | right, to the rank of their pair.
        self.pairs: dict[int, int] = {}
        for whole, rank in self.ranks.items():
            for i in range(1, len(whole)):
                left, right = self.ranks.get(whole[:i]), self.ranks.get(whole[i:])
                if left is not None and right is not None:
                    self.pairs[left << RANK_BITS | right] = rank
        #: The queue: positions by rank, and which ranks have any, as 64-bit words on two levels under a top word.
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.find = regex.compile(pattern).findall
        self.chunks = ChunkEncoder(lambda words: [b"".join(map(self._pretoken, self.find(x))) for x in words])

    def _pretoken(self, text: str) -> bytes:
        data = text.encode()
        whole = self.ranks.get(data)
        return struct.pack("<I", whole) if whole is not None else struct.pack(f"<{len(ids)}I", *ids) if (ids := self.merge(data)) else b""

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token. The queue is empty before and after."""
        pairs, buckets, low, mid, top = self.pairs.get, self.buckets, self.low, self.mid, 0
        byte = self.byte
        ids = [byte[x] for x in data]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [pairs(a << RANK_BITS | b) for a, b in zip(ids, ids[1:], strict=False)]  # of the pair that starts here
        rank.append(None)
        new = [(r, i) for i, r in enumerate(rank) if r is not None]
        while True:
            for r, i in new:
                if r in buckets:
                    heappush(buckets[r], i)
                else:
                    buckets[r] = [i]
                    a = r >> 6
                    if not low[a]:
                        b = r >> 12
                        if not mid[b]:
                            top |= 1 << b
                        mid[b] |= 1 << (a & 63)
                    low[a] |= 1 << (r & 63)
            if not top:
                break
            b = (top & -top).bit_length() - 1
            word = mid[b]
            a = b << 6 | (word & -word).bit_length() - 1
            word = low[a]
            r = a << 6 | (word & -word).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                low[a] = word = word & (word - 1)
                if not word:
                    mid[b] &= mid[b] - 1
                    if not mid[b]:
                        top &= top - 1
            new = []
            if rank[i] != r:
                continue  # stale
            j = after[i]
            after[i] = k = after[j]
            ids[i] = r
            rank[j] = rank[i] = None
            if k < n:
                before[k] = i
                rank[i] = s = pairs(r << RANK_BITS | ids[k])
                if s is not None:
                    new.append((s, i))
            h = before[i]
            if h >= 0:
                rank[h] = s = pairs(ids[h] << RANK_BITS | r)
                if s is not None:
                    new.append((s, h))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return self.chunks.of_text(text).tolist()


class Decoder:
    def __init__(self, lines: bytes) -> None:
        ranks = rank_table(lines)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.length = np.array([len(x) for x in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray, most: int = 1 << 18) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id's begin; the working memory is bounded."""
        parts = [self.data[K.ranges(self.start[x], self.length[x])].tobytes() for x in (ids[i : i + most] for i in range(0, len(ids), most))]
        return b"".join(parts), np.concatenate([[0], np.cumsum(self.length[ids])])


_built: dict[tuple, object] = {}


def built(kind: type, lines: bytes, *args: str):
    """One for each Python worker and vocabulary."""
    key = (kind, hash(lines), *args)
    if key not in _built:
        _built[key] = kind(lines, *args)
    return _built[key]


def _replacing(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _with(b: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, x in enumerate(b.schema.names) if x != name]
    return pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), column], names=[*(b.schema.names[i] for i in keep), name])


def _sent(spark: SparkSession, path: str):
    """The rank file, read here and sent to the workers; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoding(sent, pattern: str, text: str, ids: str) -> Step:
    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = built(Encoder, sent.value, pattern).chunks(*K.text_buffer(b.column(b.schema.get_field_index(text))))
        return _with(b, ids, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view("<i4"))))

    return step


def _decoding(sent, ids: str, decoded: str) -> Step:
    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(b.schema.get_field_index(ids))
        count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        data, begin = built(Decoder, sent.value).decode(lists.flatten().to_numpy())
        at = begin[np.concatenate([[0], np.cumsum(count)])].astype(np.int32)
        return _with(b, decoded, pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.array(at).buffers()[1], pa.py_buffer(data)]))

    return step


def _mapped(df: DataFrame, schema: T.StructType, text: str | None, *steps: Step) -> DataFrame:
    """All steps in one pass through Python, batch by batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.rebatched(batches, text) if text else (x.slice(i, 200) for x in batches for i in range(0, x.num_rows, 200)):
            for step in steps:
                b = step(b)
            yield b.select(schema.fieldNames())
        for kept in _built.values():
            if isinstance(kept, Encoder):
                kept.chunks.forget()

    return df.mapInArrow(B.streaming(work), schema)


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of each text, by the rank file at ``path``."""
    return _mapped(docs, _replacing(docs.schema, ids, IDS), text, _encoding(_sent(docs.sparkSession, path), pattern, text, ids))


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for; null ids give no bytes."""
    return _mapped(df, _replacing(df.schema, decoded, T.BinaryType()), None, _decoding(_sent(df.sparkSession, path), ids, decoded))


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``bpe_encode`` and ``bpe_decode`` of its ids in one pass; the text itself is left out."""
    sent = _sent(docs.sparkSession, path)
    schema = _replacing(_replacing(docs.drop(text).schema, ids, IDS), decoded, T.BinaryType())
    return _mapped(docs, schema, text, _encoding(sent, pattern, text, ids), _decoding(sent, ids, decoded))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = documents(spark, sf_dir)
    out = bpe_round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
