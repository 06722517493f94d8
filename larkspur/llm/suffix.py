"""Operator 10, suffix-array dedup: bytes covered by a 100-byte string that starts earlier.

The index is a logarithmic family. A batch of new suffixes is sorted into a suffix array
(cut off at the match length, keys inline); it is merge-scanned against each existing level
for matches of the full length; what is new becomes a level, and levels of equal size merge
geometrically, so a suffix is merged O(log n) times. Batches come in order of (document,
start), so a match in a level, or earlier in the batch, is an earlier occurrence.

To deal this out, each window of 100 bytes belongs to its minimizer, the k-gram with the
least Rabin-Karp hash: equal windows have equal minimizers at the same place, so windows
whose minimizer is unique in the corpus can't match and are left where they are, and the
others meet in the bucket of their minimizer, each bucket with its own family of levels.
Consecutive windows with one minimizer travel as one segment of at most 2 * 100 - k bytes.
Equal segments are collapsed to the earliest before they are sent, so groups of copies cost a
bucket one segment per block. In a bucket, a window whose hash is alone there is unique and
isn't indexed. Hashes only rule out: whatever is removed has been compared byte by byte.

Defined results: a null text is empty; texts shorter than the match length stay whole;
null ids come after all others; rows with equal ids are ordered by block, then text, so the
later of two repeated rows loses what the first has; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import blocks as B
from larkspur.llm import kernels as K
from larkspur.llm.session import documents

MATCH = 100
GRAM = 16
PIECE = 1 << 20
SEGMENT_BUCKET_BYTES = 3 << 20
BATCH = 1 << 15
POSITION = np.uint64((1 << 22) - 1)
NO_ID = np.iinfo(np.int64).max
SEGMENTS = "bucket int, block int, gone boolean, ids binary, ords binary, starts binary, lens binary, data binary"
REMOVED = "block int, ords binary, starts binary, lens binary"
OUTPUT = ["n_bytes", "n_removed", "spans"]


def merge_scan(level: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over two sorted arrays of distinct strings: which of the batch are in the level, both merged, and where each came from.

    The stable sort of two runs is their merge, in linear time.
    """
    both = np.concatenate([level, batch])
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    same = np.zeros(len(both), dtype=bool)
    same[1:] = ranked[1:] == ranked[:-1]
    known = np.zeros(len(batch), dtype=bool)
    known[order[same] - len(level)] = True  # the level's string comes first of two equal ones
    return known, ranked[~same], order[~same]


class IndexFamily:
    """Levels, each a suffix array cut off at one length: its strings in order, and their places in some buffer; ``add`` says which of a batch are known."""

    def __init__(self, levels: list[np.ndarray] | None = None, places: list[np.ndarray] | None = None) -> None:
        self.levels: list[np.ndarray] = levels or []
        self.places: list[np.ndarray] = places or [np.arange(len(x)) for x in self.levels]
        self.settle()

    def add(self, strings: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """For each string, in order of occurrence, whether it has come before."""
        order = np.argsort(strings, kind="stable")
        batch = strings[order]
        first = np.ones(len(batch), dtype=bool)
        first[1:] = batch[1:] != batch[:-1]
        known = ~first
        fresh = np.flatnonzero(first)
        for level in self.levels:
            hit = merge_scan(level, batch[fresh])[0]
            known[fresh[hit]] = True
            fresh = fresh[~hit]
        if len(fresh):
            self.levels.append(batch[fresh])
            self.places.append(order[fresh] if places is None else places[order[fresh]])
        self.settle()
        out = np.empty(len(strings), dtype=bool)
        out[order] = known
        return out

    def settle(self) -> None:
        """Merges levels, from the smallest up, until each is at least twice the next."""
        for i in range(len(self.levels) - 1, 0, -1):
            if len(self.levels[i - 1]) < 2 * len(self.levels[i]):
                _, self.levels[i - 1], order = merge_scan(self.levels[i - 1], self.levels[i])
                self.places[i - 1] = np.concatenate([self.places[i - 1], self.places[i]])[order]
                del self.levels[i], self.places[i]


def first_of_equal(key: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which byte ranges are the first of those equal to them; a hash finds the pairs, their bytes decide."""
    _, index, which = np.unique(key, return_index=True, return_inverse=True)
    like = index[which]
    own = like == np.arange(len(key))
    again = np.flatnonzero(~own)
    other = size[again] != size[like[again]]
    own[again[other]] = True
    again = again[~other]
    if len(again):
        same = data[K.ranges(at[again], size[again])] == data[K.ranges(at[like[again]], size[again])]
        own[again[~np.logical_and.reduceat(same, np.cumsum(size[again]) - size[again])]] = True
    return own


def document_pieces(buf: np.ndarray, offsets: np.ndarray, match: int, most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, ends of documents) of byte ranges; a longer document comes in overlapping parts."""
    for i, j in K.pieces(offsets, most):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= most:
            yield a, b, offsets[i + 1 : j + 1]
        else:
            for x in range(a, max(a + 1, b - match + 1), most):
                end = min(b, x + most + match - 1)
                yield x, end, np.array([end])


def segments(buf: np.ndarray, offsets: np.ndarray, match: int, gram: int, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, number of windows, minimizer hash, content hash) of the runs of windows of one minimizer."""
    for a, b, ends in document_pieces(buf, offsets, match, most):
        n = b - a
        if n < match:
            continue
        sums = K.prefix_sums(buf[a:b].astype(np.uint64) + np.uint64(1), K.BYTE_BASE)
        h = K.window_hashes(buf[a:b], gram, K.BYTE_BASE, sums)
        least = K.sliding_min((h & ~POSITION) | np.arange(len(h), dtype=np.uint64), match - gram + 1)
        anchor = (least & POSITION).astype(np.int64)
        edge = np.zeros(n + 1, dtype=np.int32)  # windows that would cross the end of a document
        e = np.unique(ends[ends < b] - a)
        starts = np.maximum(e - match + 1, 0)
        np.add.at(edge, starts, 1)
        np.add.at(edge, e, -1)
        at = np.flatnonzero(np.cumsum(edge)[: len(anchor)] == 0)
        if not len(at):
            continue
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[at][1:] != anchor[at][:-1]) | (at[1:] != at[:-1] + 1)
        run = np.flatnonzero(new)
        count = np.diff(np.append(run, len(at)))
        s = at[run]
        content = K.range_hashes(sums, s, s + count + match - 1, K.BYTE_BASE)
        yield a + s, count, h[anchor[s]], K.mix(content ^ (count.astype(np.uint64) * np.uint64(K.WORD_BASE)))


def minimizers(t: pa.Table, match: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    found = [f for _, _, f, _ in segments(*K.text_buffer(t["text"]), match, gram)]
    f = np.concatenate([np.zeros(0, dtype=np.uint64), *found])
    return f, K.mix(f ^ np.uint64(K.WORD_BASE_2))


def segment_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5]
    names = ["bucket", "block", "gone", "ids", "ords", "starts", "lens", "data"]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def bucket_of(minimizer: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix(minimizer ^ np.uint64(K.WORD_BASE)) % np.uint64(buckets)).astype(np.int64)


def candidates(t: pa.Table, again: np.ndarray | None, match: int, gram: int, buckets: int) -> pa.Table:
    """A block's segments whose minimizer is in ``again`` (None: all), the earliest of equal ones; the others go at once."""
    if again is not None and not len(again):
        return segment_table([])
    t = B.in_order(t)
    block = t["block"][0].as_py()
    ids = np.array([NO_ID if x is None else x for x in t["id"].to_pylist()], dtype=np.int64)
    buf, offsets = K.text_buffer(t["text"])
    parts = []
    for s, n, f, c in segments(buf, offsets, match, gram):
        keep = np.ones(len(f), dtype=bool) if again is None else K.member(f, again)
        parts.append((s[keep], n[keep], f[keep], c[keep]))
    if not parts:
        return segment_table([])
    s, n, f, c = (np.concatenate([p[i] for p in parts]) for i in range(4))
    doc = np.searchsorted(offsets, s, side="right") - 1
    own = first_of_equal(K.mix(c + f), buf, s, n + match - 1)
    rows = []
    u32 = lambda x: x.astype("<u4").tobytes()
    gone = np.flatnonzero(~own)
    if len(gone):
        rows.append((block % buckets, block, True, None, u32(doc[gone]), u32(s[gone] - offsets[doc[gone]]), u32(n[gone]), None))
    mine = np.flatnonzero(own)
    for b, p in K.split_by(bucket_of(f[mine], buckets)):
        p = mine[p]
        data = buf[K.ranges(s[p], n[p] + match - 1)].tobytes()
        rows.append((b, block, False, ids[doc[p]].tobytes(), u32(doc[p]), u32(s[p] - offsets[doc[p]]), u32(n[p]), data))
    return segment_table(rows)


def strings_at(data: np.ndarray, at: np.ndarray, match: int) -> np.ndarray:
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, match)[at]).view(f"V{match}").view(f"S{match}").ravel()


def resolved(t: pa.Table, match: int) -> pa.Table:
    """One bucket: which windows of its segments occur earlier, as runs told to the segments' blocks."""
    out = resolve(t, match)[0]
    return pa.table([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3))], names=["block", "ords", "starts", "lens"])


def resolve(t: pa.Table, match: int, family: IndexFamily | None = None, base: int = 0) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """The runs of one bucket, and its segments' bytes and numbers of windows.

    With a family that stays, all windows enter it, with their places in those bytes plus ``base``;
    without one, only those whose hash occurs again.
    """
    stays = family is not None
    family = family or IndexFamily()
    data, lens = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    rows = t.to_pylist()
    out = [(r["block"], r["ords"], r["starts"], r["lens"]) for r in rows if r["gone"]]
    rows = [r for r in rows if not r["gone"]]
    if rows:
        u32 = lambda k: np.concatenate([np.frombuffer(r[k], dtype="<u4") for r in rows]).astype(np.int64)
        ids = np.concatenate([np.frombuffer(r["ids"], dtype=np.int64) for r in rows])
        ords, starts, lens = u32("ords"), u32("starts"), u32("lens")
        block = np.repeat([r["block"] for r in rows], [len(r["lens"]) // 4 for r in rows])
        data = np.concatenate([np.frombuffer(r["data"], dtype=np.uint8) for r in rows])
        at = np.concatenate([[0], np.cumsum(lens + match - 1)[:-1]])
        stored = lens
        order = np.lexsort((starts, ords, block, ids))
        ords, starts, lens, block, at = (x[order] for x in (ords, starts, lens, block, at))
        sums = K.prefix_sums(data.astype(np.uint64) + np.uint64(1), K.BYTE_BASE)
        content = K.mix(K.range_hashes(sums, at, at + lens + match - 1, K.BYTE_BASE) ^ (lens.astype(np.uint64) * np.uint64(K.WORD_BASE)))
        own = first_of_equal(content, data, at, lens + match - 1)
        mine = np.flatnonzero(own)
        where = K.ranges(at[mine], lens[mine])
        if stays:
            maybe = np.arange(len(where))
        else:
            h = K.range_hashes(sums, where, where + match, K.BYTE_BASE)
            ranked = np.sort(h)
            twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
            maybe = np.flatnonzero(K.member(h, twice))
            del h, ranked
        del sums
        known = np.zeros(len(where), dtype=bool)
        for i in range(0, len(maybe), BATCH):
            p = maybe[i : i + BATCH]
            known[p] = family.add(strings_at(data, where[p], match), where[p] + base)
        segment = np.repeat(mine, lens[mine])
        offset = where - at[segment]
        p = np.flatnonzero(known)
        if len(p):
            new = np.ones(len(p), dtype=bool)
            new[1:] = (p[1:] != p[:-1] + 1) | (segment[p][1:] != segment[p][:-1])
            first = np.flatnonzero(new)
            run, sg = np.diff(np.append(first, len(p))), segment[p][first]
            from_ = starts[sg] + offset[p][first]
        else:
            run = sg = from_ = np.zeros(0, dtype=np.int64)
        others = np.flatnonzero(~own)
        sg, from_, run = np.concatenate([sg, others]), np.concatenate([from_, starts[others]]), np.concatenate([run, lens[others]])
        for b, q in K.split_by(block[sg]) if len(sg) else []:
            out.append((b, *(x[q].astype("<u4").tobytes() for x in (ords[sg], from_, run))))
        lens = stored
    return out, data, lens


def removed_mask(offsets: np.ndarray, back: pa.Table, match: int) -> np.ndarray:
    step = np.zeros(int(offsets[-1]) + 1, dtype=np.int32)
    for r in back.to_pylist():
        o, s, n = (np.frombuffer(r[k], dtype="<u4").astype(np.int64) for k in ("ords", "starts", "lens"))
        np.add.at(step, offsets[o] + s, 1)
        np.add.at(step, offsets[o] + s + n + match - 1, -1)
    return np.cumsum(step[:-1]) > 0


def suffix_dedup(docs: DataFrame, match: int = MATCH, id: str = "doc_id", text: str = "text", gram: int = GRAM, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """All columns of docs, the text being the kept bytes (binary), and n_bytes, n_removed, spans (byte ranges removed)."""
    total = B.size_of(docs, text)
    docs_b = B.blocked(docs, id, text, B.n_blocks(total, block_bytes))
    again = B.repeated_hashes(docs_b, lambda t: minimizers(t, match, gram), max(16, math.ceil(total / 4 / (24 << 20))))
    buckets = max(64, math.ceil(total / SEGMENT_BUCKET_BYTES))
    parts = docs_b.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(B.releasing_both(lambda t, back: candidates(t, B.gathered(back), match, gram, buckets)), SEGMENTS)
    gone = parts.groupBy("bucket").applyInArrow(B.releasing(lambda t: resolved(t, match)), REMOVED)
    return without_removed(docs, docs_b, gone, match, id, text)


def without_removed(docs: DataFrame, docs_b: DataFrame, gone: DataFrame, match: int, id: str, text: str) -> DataFrame:
    """The documents of all blocks without the runs told to them."""

    def finish(t: pa.Table, back: pa.Table) -> pa.Table:
        t = B.in_order(t)
        buf, offsets = K.text_buffer(t["text"])
        mask = removed_mask(offsets, back, match)
        n, removed, spans, kept = [], [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = mask[a:b]
            n.append(b - a)
            removed.append(int(own.sum()))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))) if removed[-1] else []
            spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kept.append((buf[a:b][~own] if removed[-1] else buf[a:b]).tobytes())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table([t["id"], t["rest"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "rest", *OUTPUT, "text"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("rest", B.struct_type(docs_b)), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("text", T.BinaryType())])
    out = docs_b.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(B.releasing_both(finish), schema)
    return B.unwrapped(out, docs, id, text, OUTPUT)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
