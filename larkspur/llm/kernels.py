"""Vectorised kernels over Arrow text: word spans, Rabin-Karp hashes, sliding minima.

All hashes are 64-bit. A polynomial hash over a sequence is taken from prefix sums of
``x[i] * base**-i`` (mod 2**64, the base being odd), so that the hash of any range is one
subtraction and one product; this is the rolling hash, for all windows at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
WORD_BASE_2 = 0xAF251AF3B0F025B5

#: Separators of words: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of plain tokens: every ASCII byte that is no letter or digit.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: A-Z to a-z, all else as it is.
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], dtype=np.uint8)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` for i < n, grown when a longer sequence comes."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U64))
        have = _powers[base] = (both[0], both[1])
    return have


def forget() -> None:
    """Drops the powers that a long sequence asked for; the next one makes them anew."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole word."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_sums(x: np.ndarray, base: int) -> np.ndarray:
    n = len(x)
    s = np.zeros(n + 1, dtype=U64)
    np.cumsum(x.astype(U64, copy=False) * powers(base, n + 1)[1][:n], out=s[1:])
    return s


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(base, len(sums))[0][starts])


def window_hashes(x: np.ndarray, k: int, base: int, sums: np.ndarray | None = None) -> np.ndarray:
    """The hash of each window of k items; empty if there are fewer."""
    n = len(x)
    if n < k:
        return np.zeros(0, dtype=U64)
    s = prefix_sums(x, base) if sums is None else sums
    return mix((s[k:] - s[:-k]) * powers(base, n + 1)[0][: n - k + 1])


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separators; no run crosses a document."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = ~separators[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = word[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = word[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of documents with at most so many bytes together, or one longer document."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        out.append((i, min(j, n)))
        i = out[-1][1]
    return out


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = SPACE, most: int = 1 << 20, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word (of its ``first`` bytes, unless 0), and the offsets of each document's words.

    Bytes are hashed in runs of about ``most``, cut between words, so that a very long
    document takes no more working memory than a short one besides 8 bytes a word.
    """
    starts, ends = word_spans(buf, offsets, separators)
    out = np.zeros(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, side="right")))
        at = starts[i]
        part = buf[at : ends[j - 1]]
        sums = prefix_sums((LOWER[part] if lower else part).astype(U64) + U64(1), BYTE_BASE)
        stop = np.minimum(ends[i:j], starts[i:j] + first) if first else ends[i:j]
        out[i:j] = range_hashes(sums, starts[i:j] - at, stop - at, BYTE_BASE)
        i = j
    return out, np.searchsorted(starts, offsets)


def inside(word_offsets: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n - k + 1 windows of k words lie in one document."""
    if n < k:
        return np.zeros(0, dtype=bool)
    doc = np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))
    return doc[: n - k + 1] == doc[k - 1 :]


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n, size, cur = len(a), 1, a
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return cur if size == w else np.minimum(cur[: n - w + 1], cur[w - size : w - size + n - w + 1])


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``among``."""
    if len(among) == 0:
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift


def pack(x: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes: the high planes are runs, which shuffle compression removes."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def split_by(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, indices in input order) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[p[0]]), p) for p in np.split(order, cut) if len(p)]
