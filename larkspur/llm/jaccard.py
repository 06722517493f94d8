"""Operator 7, n-gram Jaccard join by parity sketches, and the components of its links.

A document's set holds the hashes of its distinct shingles. Documents with equal sets form a
class, so copies of any number count once. Sets are joined per size band: sets with Jaccard
similarity of at least t differ in at most D tokens, D following from the band's sizes. A
parity sketch deals the tokens to T > D pieces by their hash and XORs each piece's tokens. One
differing token changes one piece at most, so the number of differing pieces bounds the
symmetric difference from below, and of T pieces T - D at least agree (pigeonhole): two similar
sets share a piece that isn't empty, for T exceeds D plus the number of empty pieces; a set
with more empty pieces than that also sends its empty ones, so nothing is lost. Pieces are keys
that meet in buckets, packed. No pair is formed there: a set first gets a link to the least of
those it meets; then each set of a group that isn't all connected yet gets one link to the
nearest of another component, until that connects nothing more; last, what is still apart is
compared in full, block by block for large groups. Each pair must pass bit sketches (XOR of one bit for each
token), whose Hamming distance again bounds the symmetric difference, and what passes is
verified on the sets themselves. Components are those of verified links, by alternating steps
to stars, checkpointed.

Defined results: a text without words, or null, has an empty set and is linked with nothing;
its component is its own id. A text with fewer words than a shingle has its whole sequence as
one. Rows that share an id are one node of the components if they are linked, and each gets its
row; a null id takes part in links but names a component only if no other id does. An empty
table gives an empty one; other columns are handed through, namesakes of outputs replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import blocks as B
from larkspur.llm import kernels as K
from larkspur.llm.session import documents

SHINGLE = 5
#: Similarity of at least NUM / DEN links.
NUM, DEN = 80, 100
LEAST_BUCKETS = 32
BUCKET_BYTES = 24 << 20
FLUSH_BYTES = 8 << 20
#: Rounds of links to the nearest, at most; the comparison in full after them loses nothing.
ROUNDS = 4
#: Groups in which a set asks in a round, at most.
ASKS = 6
#: Members of a group that one block compares with as many others.
CHUNK = 2048
#: Comparisons that a task makes at once.
SLAB = 1 << 19
#: Up to so many ids (8 MB) of texts to verify are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def shingle_sets(column, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w, at = K.words(*K.text_buffer(column), lower=True)
    h = K.window_hashes(w, size, K.WORD_BASE)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(h[a : b - size + 1]))
        elif n:
            out.append(K.mix(K.window_hashes(w[a:b], n, K.WORD_BASE_2) + np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """One number for a set; 0 for the empty one."""
    if not len(s):
        return 0
    return int(K.mix(np.array([K.mix(s ^ np.uint64(K.WORD_BASE_2)).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0]) or 1


class Bands:
    """Size bands; a set meets others on the level of its band and on the one below."""

    def __init__(self, num: int = NUM, den: int = DEN) -> None:
        self.num, self.den, self.low = num, den, [1]

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def differ(self, level: int) -> int:
        """The most tokens in which similar sets differ, the smaller one being of this band."""
        self.band(self.low[level] if level < len(self.low) else 1)
        while len(self.low) < level + 2:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        small = self.low[level + 1] - 1
        both = small + small * self.den // self.num
        return both * (self.den - self.num) // (self.den + self.num)

    def pieces(self, level: int) -> int:
        d = self.differ(level)
        return d + 2 + (d + 1) // 8


def piece_keys(s: np.ndarray, level: int, pieces: int, differ: int) -> np.ndarray:
    """The keys of a set's pieces on a level."""
    piece = (K.mix(s + np.uint64(level + 1)) >> np.uint64(11)) % np.uint64(pieces)
    order = np.argsort(piece, kind="stable")
    piece, x = piece[order], K.mix(s[order] ^ np.uint64(K.BYTE_BASE))
    at = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    value, which = np.bitwise_xor.reduceat(x, at), piece[at]
    if pieces - len(at) >= pieces - differ:  # too many empty pieces for the bound
        empty = np.setdiff1d(np.arange(pieces, dtype=np.uint64), which)
        value, which = np.concatenate([value, np.zeros(len(empty), dtype=np.uint64)]), np.concatenate([which, empty])
    return K.mix(value ^ K.mix(which + np.uint64(level << 32)))


def set_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    b = bands.band(len(s))
    keys = [piece_keys(s, x, bands.pieces(x), d) for x in (b, b - 1) if x >= 0 and (d := bands.differ(x))]
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def key_rows(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed per bucket: for each class its number of keys, and 40 bits of each key; copies count once."""
    bands = Bands()
    keys: list[np.ndarray] = []
    classes: dict[int, int] = {}

    def flush() -> pa.RecordBatch:
        cls = np.array(list(classes), dtype=np.int64)
        owner = np.repeat(np.arange(len(cls)), [len(k) for k in keys])
        every = np.concatenate(keys)
        rows: tuple[list, ...] = ([], [], [], [], [])
        for b, p in K.split_by(((every & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)):
            mine, count = np.unique(owner[p], return_counts=True)
            k = every[p] >> np.uint64(24)
            for column, v in zip(rows, (b, cls[mine].tobytes(), count.astype("<u4").tobytes(), (k & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (k >> np.uint64(32)).astype(np.uint8).tobytes()), strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["bucket", "classes", "counts", "low", "high"])

    held = 0
    for b in B.rebatched(batches, "text"):
        for s in shingle_sets(b.column(0), size):
            c = class_of(s)
            if c and c not in classes and len(k := set_keys(s, bands)):
                classes[c] = 1
                keys.append(k)
                held += len(k) * 8
        if held >= FLUSH_BYTES:
            yield flush()
            keys, held = [], 0
            classes.clear()
    if keys:
        yield flush()


def bucket_groups(t: pa.Table) -> pa.Table:
    """One bucket: the classes of each key that at least two have, each set of members once."""
    cls = np.concatenate([np.repeat(np.frombuffer(r["classes"], dtype=np.int64), np.frombuffer(r["counts"], dtype="<u4")) for r in t.select(["classes", "counts"]).to_pylist()])
    key = np.concatenate([np.frombuffer(x, dtype="<u4") for x in t["low"].to_pylist()]).astype(np.uint64) | np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in t["high"].to_pylist()]).astype(np.uint64) << np.uint64(32)
    ranked = np.sort(key)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    p = np.flatnonzero(K.member(key, twice))
    key, cls = key[p], cls[p]
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls = key[new], cls[new]
    if not len(key):
        return pa.table({"gid": pa.array([], pa.int64()), "cls": pa.array([], pa.int64())})
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(at, len(key)))
    gid = K.mix(np.add.reduceat(K.mix(cls.view(np.uint64)), at) + n.astype(np.uint64))
    first = np.zeros(len(at), dtype=bool)
    first[np.unique(gid, return_index=True)[1]] = True
    keep = np.flatnonzero(first & (n > 1))
    return pa.table({"gid": pa.array(np.repeat(gid[keep], n[keep]).view(np.int64)), "cls": pa.array(cls[K.ranges(at[keep], n[keep])])})


def sketch(s: np.ndarray) -> np.ndarray:
    """One bit for each token, XORed; twice to four times as many bits as tokens."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    place = (K.mix(s ^ np.uint64(K.WORD_BASE)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1)


def folded(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def near_pairs(rows: Iterator[pa.RecordBatch], nearest: bool, num: int = NUM, den: int = DEN) -> Iterator[pa.RecordBatch]:
    """Pairs of other components that the bound doesn't rule out, from rows sorted by their block (gid, i, j).

    A block's rows of side -1 and 0 ask, those of side -1 and 1 answer; rows of the group's home
    component only answer. With ``nearest`` an asking set gets only the one of least distance.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in rows:
        if not b.num_rows:
            continue
        block = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)])
        if last is not None and (block[:, 0] != last).any():
            yield from block_pairs(held, nearest, num, den)
            held = []
        last = block[:, -1]
        new = np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1
        whole = int(new[-1]) if len(new) else 0
        if whole:
            yield from block_pairs([*held, b.slice(0, whole)], nearest, num, den)
            held = []
        held.append(b.slice(whole))
    if held:
        yield from block_pairs(held, nearest, num, den)


def block_pairs(held: list[pa.RecordBatch], nearest: bool, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs of whole blocks, all blocks at once, in slabs of a bounded number of comparisons."""
    t = pa.Table.from_batches(held)
    gid, i, j, side, cls, comp, n = (t[c].to_numpy() for c in ("gid", "i", "j", "side", "cls", "comp", "n"))
    home = t["home"].to_numpy(zero_copy_only=False)
    raw = [np.frombuffer(x, dtype=np.uint8) for x in t["sketch"].to_pylist()]
    width = np.array([len(x) for x in raw], dtype=np.int64)
    start = np.flatnonzero(np.concatenate([[True], (gid[1:] != gid[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    length = np.diff(np.append(start, len(gid)))
    of = np.repeat(np.arange(len(start)), length)
    ask = np.flatnonzero((side <= 0) & ~home)
    at = np.concatenate([[0], np.cumsum(length[of[ask]])])
    matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at_size(size: int) -> tuple[np.ndarray, np.ndarray]:
        """The sketches folded to a size, and the place of each row among them."""
        if size not in matrices:
            mine = np.flatnonzero((width == size) | (width == 2 * size))
            place = np.zeros(len(raw), dtype=np.int64)
            place[mine] = np.arange(len(mine))
            matrices[size] = np.stack([folded(raw[k], size) for k in mine]).view(np.uint64), place
        return matrices[size]

    lo = 0
    while lo < len(ask):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLAB, side="right")) - 1)
        q = ask[lo:hi]
        lo = hi
        x = np.repeat(q, length[of[q]])
        y = K.ranges(start[of[q]], length[of[q]])
        ok = (side[y] != 0) & (comp[x] != comp[y])
        if not nearest:
            ok &= home[y] | (cls[y] > cls[x])
        x, y = x[ok], y[ok]
        ok = np.minimum(n[x], n[y]) * den >= num * np.maximum(n[x], n[y])
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        size = np.minimum(width[x], width[y])
        far = np.zeros(len(x), dtype=np.int64)
        for w in np.unique(size).tolist():
            bits, place = at_size(w)
            p = np.flatnonzero(size == w)
            step = max(1, SLAB * 16 // w)
            for k in range(0, len(p), step):
                c = p[k : k + step]
                far[c] = np.bitwise_count(bits[place[x[c]]] ^ bits[place[y[c]]]).sum(axis=1, dtype=np.int64)
        ok = far * (num + den) <= (n[x] + n[y]) * (den - num)
        x, y, far = x[ok], y[ok], far[ok]
        u, v = cls[x], cls[y]
        if nearest:
            k = np.lexsort((v, far, u))
            k = k[np.concatenate([[True], u[k][1:] != u[k][:-1]])] if len(k) else k
            u, v, far = u[k], v[k], far[k]
        else:
            u, v = np.minimum(u, v), np.maximum(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(far)], names=["u", "v", "far"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that edges (u, v) lead to; by alternating large and small stars."""
    now = B.compacted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), "m")
        small = large.join(down, F.col("u") == F.col("at")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = B.compacted(small.where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def plausible(pairs: DataFrame, classes: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs (u, v) that sizes and sketches don't rule out."""
    side = lambda x: classes.select(F.col("cls").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    near = pairs.join(side("u"), F.col("u") == F.col("cu")).join(side("v"), F.col("v") == F.col("cv"))
    near = near.where(F.least("nu", "nv") * den >= num * F.greatest("nu", "nv")).select("u", "v", "nu", "nv", "su", "sv")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            far = []
            for a, b in zip(x.column(4).to_pylist(), x.column(5).to_pylist(), strict=True):
                a, b = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
                size = min(len(a), len(b))
                far.append(int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum()))
            both = x.column(2).to_numpy() + x.column(3).to_numpy()
            yield x.select(["u", "v"]).filter(pa.array(np.array(far, dtype=np.int64) * (num + den) <= both * (den - num)))

    return near.mapInArrow(work, "u long, v long")


def verified(pairs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar."""
    left = pairs.join(sets.select(F.col("cls").alias("cu"), F.col("tokens").alias("a")), F.col("u") == F.col("cu")).select("u", "v", "a")
    both = left.join(sets.select(F.col("cls").alias("cv"), F.col("tokens").alias("b")), F.col("v") == F.col("cv")).select("u", "v", "a", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for a, b in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                a, b = K.unpack(a), K.unpack(b)
                both = int(K.member(a, b).sum())
                ok.append(den * both >= num * (len(a) + len(b) - both))
            yield x.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(B.streaming(work), "u long, v long")


def labelled(only: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, bool]:
    """A row for each of ``only`` (id, text): id, n_shingles, component_id, cls and root (the component's name
    among classes); and whether rows with one id differ in their sets."""
    total = B.size_of(only, "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.rebatched(batches, "text"):
            sets = shingle_sets(b.column(1), size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["id", "n", "cls", "sketch"])

    # Small rows: id, size, class and sketch of every document.
    rows = B.checkpointed(only.mapInArrow(B.streaming(measured), "id long, n long, cls long, sketch binary"))
    classes = B.compacted(rows.where("cls <> 0").groupBy("cls").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    buckets = max(LEAST_BUCKETS, math.ceil(total * 0.6 / BUCKET_BYTES))
    keys = only.select("text").mapInArrow(B.streaming(lambda it: key_rows(it, size, buckets)), "bucket int, classes binary, counts binary, low binary, high binary")
    members = B.compacted(keys.groupBy("bucket").applyInArrow(B.releasing(bucket_groups), "gid long, cls long").distinct())
    repeated_ids = rows.groupBy("id").agg(F.countDistinct("cls").alias("k")).where("k > 1").limit(1).count()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.rebatched(batches, "text"):
            sets = shingle_sets(b.column(1), size)
            own = pa.array([class_of(s) for s in sets], pa.int64())
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array([K.pack(s) for s in sets], pa.binary())], names=["cls", "tokens"])
            yield out.filter(pc.equal(own, b.column(0)))  # ids may repeat

    def verify(pairs: DataFrame) -> DataFrame:
        """By the sets of one document of each class in a pair."""
        pairs = B.compacted(pairs)
        ends = pairs.select(F.explode(F.array("u", "v")).alias("e")).distinct()
        chosen = B.compacted(classes.join(ends, F.col("cls") == F.col("e"), "left_semi").select(F.col("first").alias("f"), "cls"))
        few = chosen.count() <= BROADCAST_IDS
        sources = only.join(F.broadcast(chosen) if few else chosen, F.col("id").eqNullSafe(F.col("f"))).select("cls", "text")
        sets = sources.mapInArrow(B.streaming(tokens), "cls long, tokens binary")
        if repeated_ids:
            sets = sets.groupBy("cls").agg(F.first("tokens").alias("tokens"))
        return B.compacted(verified(pairs, B.checkpointed(sets)))

    least = members.groupBy("gid").agg(F.min("cls").alias("m")).withColumnRenamed("gid", "g")
    links = members.join(least, F.col("gid") == F.col("g")).where("cls <> m").groupBy("cls").agg(F.min("m").alias("v")).select(F.col("cls").alias("u"), "v")
    every = components(verify(plausible(links, classes)))

    def apart(comp: DataFrame, round_: int | None) -> DataFrame:
        """Pairs (u, v, far) of sets in groups that hold more than one component.

        In a round a set asks for its nearest in ASKS of its groups, others each round; without one in all, for all.
        """
        placed = members.join(comp, F.col("cls") == F.col("node"), "left").select("gid", "cls", F.coalesce("root", "cls").alias("comp"))
        # The largest component of a group is its home: its sets answer and needn't ask.
        parts = placed.groupBy("gid", "comp").agg(F.count("*").alias("k"))
        groups = parts.groupBy(F.col("gid").alias("g")).agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("most")).where("size > most.k")
        chunks = lambda c: F.ceil(c / CHUNK).cast("int")
        groups = groups.select("g", F.col("most.comp").alias("at_home"), chunks(F.col("size") - F.col("most.k")).alias("asking"), chunks(F.col("size")).alias("answering"))
        open_ = placed.join(groups, F.col("gid") == F.col("g")).withColumn("home", F.col("comp") == F.col("at_home"))
        if round_ is not None:
            turn = F.row_number().over(Window.partitionBy("cls", "home").orderBy(F.xxhash64("gid", F.lit(round_)), "gid"))
            open_ = open_.withColumn("home", F.col("home") | (turn > ASKS))
        mine = lambda c, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(c)).cast("int")
        open_ = open_.withColumn("a", mine("asking", 1)).withColumn("b", mine("answering", 2))
        # A set answers in its column of blocks and, unless at home, asks in its row of blocks.
        column = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda i: F.struct(i.alias("i"), F.col("b").alias("j"), F.when(~F.col("home") & (i == F.col("a")), -1).otherwise(1).alias("side")))
        row = F.transform(F.filter(F.sequence(F.lit(0), F.col("answering") - 1), lambda j: ~F.col("home") & (j != F.col("b"))), lambda j: F.struct(F.col("a").alias("i"), j.alias("j"), F.lit(0).alias("side")))
        spread = open_.select("gid", "cls", "comp", "home", F.explode(F.concat(column, row)).alias("p")).select("gid", "p.i", "p.j", "p.side", "cls", "comp", "home")
        dealt = spread.join(classes.select(F.col("cls").alias("c"), "n", "sketch"), F.col("cls") == F.col("c")).select("gid", "i", "j", "side", "cls", "comp", "home", "n", "sketch")
        return dealt.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(B.streaming(lambda it: near_pairs(it, round_ is not None)), "u long, v long, far long")

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        """Components of the old ones and new links, the links as links of old components."""
        at = lambda x: comp.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}"))
        up = links.join(at("u"), F.col("u") == F.col("nu"), "left").join(at("v"), F.col("v") == F.col("nv"), "left")
        up = up.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).distinct()
        return components(comp.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(up))

    for round_ in range(ROUNDS):
        B.tidied(only.sparkSession)
        tried = B.compacted(apart(every, round_).groupBy("u").agg(F.min_by("v", F.struct("far", "v")).alias("v")))
        new = verify(tried)
        found = new.count()
        if found:
            every = joined(every, new)
        if 2 * found < tried.count():  # what remains are mostly sets that only seem near
            break
    B.tidied(only.sparkSession)
    every = joined(every, verify(apart(every, None).select("u", "v").distinct()))

    of = classes.join(every, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    name = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of.join(name, "root").select(F.col("cls").alias("c"), "component_id", "root")
    result = rows.join(named, F.col("cls") == F.col("c"), "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "cls", "root")
    return result, bool(repeated_ids)


def boxed(docs: DataFrame, id: str, text: str, size: int, with_class: bool) -> DataFrame:
    """id, row (all columns as one struct, so that no name of theirs clashes) and, if asked for, the class."""
    names = docs.columns
    one = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    if not with_class:
        return one

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1).field(names.index(text)).cast(pa.string()), size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([class_of(s) for s in sets], pa.int64())], names=["id", "row", "cls"])

    return one.mapInArrow(B.streaming(work), T.StructType([*one.schema.fields, T.StructField("cls", T.LongType())]))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, and n_shingles and component_id, the smallest id that links lead to."""
    only = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    result, differ = labelled(only, size)
    # Columns come back by id; rows that share an id but not their set are told apart by their class.
    labels = result.groupBy(F.col("id").alias("i"), F.col("cls").alias("c")).agg(F.first("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    same = F.col("id").eqNullSafe(F.col("i"))
    joined = boxed(docs, id, text, size, differ).join(labels, same & (F.col("cls") == F.col("c")) if differ else same)
    kept = [f for f in docs.columns if f not in ("n_shingles", "component_id")]
    return joined.select(*[F.col("row").getField(f).alias(f) for f in kept], "n_shingles", "component_id")


def deduplicated(docs: DataFrame, size: int = SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: one with its smallest id (null only if all are), and of such rows the
    one of least class, then of least hash. Rows with an empty set have no copies and all stay."""
    only = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    result, differ = labelled(only, size)
    first = result.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "cls")).alias("m")).select(F.col("m.id").alias("i"), F.col("m.cls").alias("c"))
    repeats = result.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count()
    if not repeats:  # then an id is a row
        gone = B.checkpointed(result.where("n_shingles > 0").select("id").join(first.select("i"), F.col("id").eqNullSafe(F.col("i")), "left_anti").withColumnRenamed("id", "gone__"))
        few = gone.count() <= BROADCAST_IDS
        return docs.join(F.broadcast(gone) if few else gone, F.col(f"`{id}`").cast("long").eqNullSafe(F.col("gone__")), "left_anti")
    rows = boxed(docs, id, text, size, True)
    kept = rows.where("cls <> 0").join(first, F.col("id").eqNullSafe(F.col("i")) & (F.col("cls") == F.col("c")), "left_semi")
    one = kept.groupBy("id", "cls").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return one.unionByName(rows.where("cls = 0").select("row")).select("row.*")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out, _ = labelled(docs.select(F.col("doc_id").alias("id"), "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
