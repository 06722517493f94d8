"""Operator 10 over batches that come one after the other: the logarithmic family of levels as a stored table.

A version of the index is one Parquet table with a row per bucket and level: the segments' bytes,
their numbers of windows, and the level's suffix array, which is the places of its windows in those
bytes, in the order of the windows' own bytes. A batch's windows are dealt to the same buckets by
their minimizers, sorted, merge-scanned against every level of the bucket and become a level
themselves; levels merge geometrically, so a window is merged O(log n) times. As the scan reads every
level anyway, a batch writes the next version whole; a version counts once its ``about`` is
written, so a run that is lost on the way leaves the one before.

Buckets double when the index outgrows them; a level's rows are split by its segments' minimizers,
which keeps their order. A bucket holds about ``bucket_bytes`` of indexed text, whatever the index's size,
unless one minimizer has more different windows than that.

Unlike the one-run operator no window is left out, for a later batch may hold any of them: the table
takes some 3.3 bytes of segments and 4 of places for each byte of new text.

Defined results: whatever an earlier batch holds comes earlier, whatever its ids; within a batch, and
for null and empty texts, null and equal ids and empty tables, as in ``suffix_dedup``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import blocks as B
from larkspur.llm import kernels as K
from larkspur.llm.suffix import GRAM, MATCH, POSITION, REMOVED, SEGMENTS, IndexFamily, bucket_of, candidates, resolve, strings_at, without_removed

BUCKET_BYTES = 1 << 19
LEAST_BUCKETS = 64
#: A level's suffix array (starts), windows of each segment (lens) and bytes (data); without a level, runs removed from a block.
STORED = "bucket int, level int, block int, ords binary, starts binary, lens binary, data binary"


def stored_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    names = ["bucket", "level", "block", "ords", "starts", "lens", "data"]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype="<u4").astype(np.int64)


def begins(lens: np.ndarray, match: int) -> np.ndarray:
    """Where each segment begins, from its number of windows."""
    size = lens + match - 1
    return np.cumsum(size) - size


def level_row(bucket: int, level: int, places: np.ndarray, lens: np.ndarray, data: np.ndarray, match: int) -> tuple:
    """A level by itself: only the segments that its places lie in."""
    at = begins(lens, match)
    segment = np.searchsorted(at, places, side="right") - 1
    used, which = np.unique(segment, return_inverse=True)
    moved = begins(lens[used], match)[which] + places - at[segment]
    return bucket, level, None, None, moved.astype("<u4").tobytes(), lens[used].astype("<u4").tobytes(), data[K.ranges(at[used], lens[used] + match - 1)].tobytes()


def advanced(t: pa.Table, levels: pa.Table, match: int) -> pa.Table:
    """One bucket: the runs of the batch's segments that are known, and the bucket's levels with the batch."""
    bucket = (t if t.num_rows else levels)["bucket"][0].as_py()
    old = sorted(levels.to_pylist(), key=lambda r: r["level"])
    parts, all_lens, places, base = [], [], [], 0
    for r in old:
        parts.append(np.frombuffer(r["data"], dtype=np.uint8))
        all_lens.append(numbers(r["lens"]))
        places.append(numbers(r["starts"]) + base)
        base += len(parts[-1])
    before = np.concatenate([np.zeros(0, dtype=np.uint8), *parts])
    family = IndexFamily([strings_at(before, p, match) for p in places], places)
    out, data, lens = resolve(t, match, family, base)
    data = np.concatenate([before, data])
    lens = np.concatenate([*all_lens, lens])
    rows = [(bucket, None, *r, None) for r in out]
    return stored_table(rows + [level_row(bucket, k, p, lens, data, match) for k, p in enumerate(family.places)])


def segment_minimizers(data: np.ndarray, lens: np.ndarray, match: int, gram: int) -> np.ndarray:
    """Each segment's minimizer, from its first window."""
    sums = K.prefix_sums(data.astype(np.uint64) + np.uint64(1), K.BYTE_BASE)
    h = K.window_hashes(data, gram, K.BYTE_BASE, sums)
    at = begins(lens, match)
    least = np.lib.stride_tricks.sliding_window_view(h & ~POSITION, match - gram + 1)[at].argmin(axis=1)
    return h[at + least]


def redealt(r: dict, buckets: int, match: int, gram: int) -> list[tuple]:
    """A level's row, split into those of more buckets; each part of the suffix array stays sorted."""
    data, lens, places = np.frombuffer(r["data"], dtype=np.uint8), numbers(r["lens"]), numbers(r["starts"])
    to = bucket_of(segment_minimizers(data, lens, match, gram), buckets)
    segment = np.searchsorted(begins(lens, match), places, side="right") - 1
    return [level_row(b, r["level"], places[p], lens, data, match) for b, p in K.split_by(to[segment])]


class StoredFamily:
    """An index at a path that all executors reach; ``add`` takes the next batch."""

    def __init__(self, spark: SparkSession, path: str, match: int = MATCH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS) -> None:
        self.spark, self.path, self.match, self.gram, self.bucket_bytes, self.least_buckets = spark, path, match, gram, bucket_bytes, least_buckets

    def _at(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(map(str, (self.path, *parts))))

    def versions(self) -> list[int]:
        """The finished versions, oldest first."""
        fs = self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(self._at())] if fs.exists(self._at()) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._at(n, "about", "_SUCCESS")))

    def add(self, docs: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
        """As ``suffix_dedup`` returns it, judged against all earlier batches too; the batch is indexed when this returns.

        ``docs`` is to give the same rows each time it is read. The result reads the new version, which the add after the next deletes.
        """
        spark, match, gram = self.spark, self.match, self.gram
        known = self.versions()
        last = known[-1] if known else 0
        about = spark.read.parquet(f"{self.path}/{last}/about").first() if known else None
        if about and (about.match, about.gram) != (match, gram):
            raise ValueError(f"the index was built for matches of {about.match} bytes and minimizers of {about.gram}")
        size = B.size_of(docs, text)
        total = size + (about.bytes if about else 0)
        wanted = max(self.least_buckets, math.ceil(total / self.bucket_bytes))
        buckets = about.buckets if about else wanted
        while buckets < wanted:
            buckets *= 2
        levels = spark.read.parquet(f"{self.path}/{last}/index").where("level IS NOT NULL") if known else spark.createDataFrame([], STORED)
        if about and buckets != about.buckets:

            def split(batches):
                for b in batches:
                    for r in b.to_pylist():
                        yield from stored_table(redealt(r, buckets, match, gram)).to_batches()

            levels = levels.mapInArrow(B.streaming(split), STORED)
        docs_b = B.blocked(docs, id, text, B.n_blocks(size, block_bytes))
        parts = docs_b.groupBy("block").applyInArrow(B.releasing(lambda t: candidates(t, None, match, gram, buckets)), SEGMENTS)
        both = parts.groupBy("bucket").cogroup(levels.groupBy("bucket"))
        both.applyInArrow(B.releasing_both(lambda t, old: advanced(t, old, match)), STORED).write.mode("overwrite").parquet(f"{self.path}/{last + 1}/index")
        row = (buckets, total, match, gram)
        spark.createDataFrame([row], "buckets long, bytes long, match int, gram int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{last + 1}/about")
        for v in known[:-1]:
            p = self._at(v)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        names = [c.split()[0] for c in REMOVED.split(", ")]
        gone = spark.read.parquet(f"{self.path}/{last + 1}/index").where("level IS NULL").select(*names)
        return without_removed(docs, docs_b, gone, match, id, text)
