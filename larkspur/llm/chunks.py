"""Cuts texts into chunks that a byte-level BPE encodes independently, and encodes each distinct chunk once.

The pre-tokenizer's pattern never joins a non-space character to a following space, and a space
before a non-space starts a match; nor does a match run on from an ASCII letter to an ASCII mark.
Cuts before such spaces and marks therefore leave the matches as they are, and a cut that isn't
made changes nothing, so a byte that may begin a wider space forbids one. Chunks are mostly
" word" and repeat a lot: those of a batch are dealt to their distinct values by an exact hash
table over the text's own buffer, only these are looked up, and ids are put together by position.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from larkspur.llm import kernels as K

#: What may begin a space of any width: ASCII spaces and the lead bytes of the others.
MAYBE_SPACE = np.zeros(256, dtype=bool)
MAYBE_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
LETTER = np.array([i < 128 and chr(i).isalpha() for i in range(256)])
MARK = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])
#: Chunks that are put together at once.
STEP = 1 << 20
#: Chunks that are encoded in one call.
FRESH = 1 << 14


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin, and the end of the last one; no chunk crosses a document."""
    n = len(buf)
    cut = np.zeros(n + 1, dtype=bool)
    if n:
        cut[: n - 1] = (buf[:-1] == 32) & ~MAYBE_SPACE[buf[1:]]
        cut[1:n] |= LETTER[buf[:-1]] & MARK[buf[1:]]
        cut[offsets[1:][offsets[1:] > 0] - 1] &= ~(buf[offsets[1:][offsets[1:] > 0] - 1] == 32)  # a space that ends a text
    cut[offsets] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Texts to ids, by a function that gives the ids (little-endian, 32 bits) of each of a list of chunks.

    What it gave for short chunks is kept in two generations of so many chunks; a full one becomes
    the old one, and what is found there again moves to the new one.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 250_000, longest: int = 48) -> None:
        self.encode, self.most, self.longest = encode, most, longest
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Empties what is kept; tasks call it at their end, as idle workers are kept with all they hold."""
        self.new, self.old = {}, {}

    def distinct(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, words))
        lost = [i for i, x in enumerate(found) if x is None]
        old = [self.old.get(words[i]) for i in lost]
        fresh = [i for i, x in zip(lost, old, strict=True) if x is None]
        for i, x in zip(lost, old, strict=True):
            if x is not None:
                found[i] = self.new[words[i]] = x
        for a in range(0, len(fresh), FRESH):
            some = [words[i] for i in fresh[a : a + FRESH]]
            made = self.encode([x.decode() for x in some])
            for i, x in zip(fresh[a : a + FRESH], made, strict=True):
                found[i] = x
            self.new.update((w, x) for w, x in zip(some, made, strict=True) if len(w) <= self.longest)
        return found

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, and where each document's begin."""
        at = cuts(buf, offsets)
        parts, before = [], [np.zeros(1, dtype=np.int64)]
        for a in range(0, len(at) - 1, STEP):
            mine = at[a : a + STEP + 1]
            data = np.ascontiguousarray(buf[mine[0] : mine[-1]])
            chunks = pa.Array.from_buffers(pa.binary(), len(mine) - 1, [None, pa.py_buffer((mine - mine[0]).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
            ids = self.distinct(chunks.dictionary.to_pylist())
            length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            which = chunks.indices.to_numpy()
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            parts.append(flat[K.ranges((np.cumsum(length) - length)[which], length[which])])
            before.append(before[-1][-1] + np.cumsum(length[which]))
        every = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
        return every, np.concatenate(before)[np.searchsorted(at, offsets)]

    def of_text(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return self(data, np.array([0, len(data)]))[0]
