"""The stored index of operator 10: batches one after the other against one run and brute force."""

import hashlib

import numpy as np
import pytest
from test_dedup import SCHEMA, brute_bytes, corpus

from larkspur.llm import kernels as K
from larkspur.llm.suffix import IndexFamily, op10_suffix_dedup, segments, strings_at
from larkspur.llm.suffixindex import StoredFamily, numbers, segment_minimizers


def digests(out):
    return [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.text).hexdigest()) for r in out.collect()]


@pytest.mark.parametrize(("match", "bucket_bytes"), [(20, 1 << 19), (100, 1500)])
def test_batches(spark, tmp_path, match, bucket_bytes):
    """Each batch opens the index anew; the smaller buckets double between batches."""
    rows = [(i, t) for i, (_, t) in enumerate(corpus(match))]
    got = []
    for a, b in [(0, 10), (10, 11), (11, 11), (11, 40), (40, len(rows))]:
        family = StoredFamily(spark, f"file://{tmp_path}/index", match, 16 if match == 100 else 8, bucket_bytes, 4)
        got += digests(family.add(spark.createDataFrame([(i, t, 7, "own") for i, t in rows[a:b]], SCHEMA)))
    assert sorted(got, key=str) == brute_bytes(rows, match)
    assert len(family.versions()) == 2
    index = spark.read.parquet(f"{tmp_path}/index/5/index").where("level IS NOT NULL").collect()
    texts = [(t or "").encode() for _, t in rows]
    windows = {t[i : i + match] for t in texts for i in range(len(t) - match + 1)}
    assert sum(len(r.starts) // 4 for r in index) == len(windows)
    sizes = {}
    for r in sorted(index, key=lambda r: r.level):
        s = strings_at(np.frombuffer(r.data, dtype=np.uint8), numbers(r.starts), match)
        assert (s[1:] > s[:-1]).all()
        assert sizes.get(r.bucket, 1 << 40) >= 2 * len(s)
        sizes[r.bucket] = len(s)
    about = spark.read.parquet(f"{tmp_path}/index/5/about").first()
    assert about.bytes == sum(map(len, texts)) and (bucket_bytes > 1500 or about.buckets > 4)


def test_earlier_batch_comes_first(spark, tmp_path):
    """Whatever its ids; and a version without its ``about`` doesn't count."""
    t = "".join(chr(97 + i % 26) + str(i) for i in range(120))
    family = StoredFamily(spark, str(tmp_path / "index"))
    first = family.add(spark.createDataFrame([(9, t), (None, None)], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_removed) for r in first.collect()) == [(0, 0), (9, 0)]
    (tmp_path / "index" / "2" / "index").mkdir(parents=True)
    second = family.add(spark.createDataFrame([(1, "x" + t)], "doc_id long, text string"))
    assert [(r.doc_id, r.n_removed, r.text) for r in second.collect()] == [(1, len(t), b"x")]
    with pytest.raises(ValueError):
        StoredFamily(spark, str(tmp_path / "index"), 50).add(second)


def test_whole_table_in_batches(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    family = StoredFamily(spark, str(tmp_path / "index"))
    cut = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    ends = [cut[0], cut[len(cut) // 2], cut[len(cut) * 3 // 4], cut[-1] + 1]
    got = [d for a, b in zip(ends, ends[1:], strict=False) for d in digests(family.add(docs.where(f"doc_id >= {a} AND doc_id < {b}")))]
    assert sorted(got, key=str) == sorted((tuple(r) for r in op10_suffix_dedup(spark, sf).collect()), key=str)


def test_segments_keep_their_minimizers():
    buf, offsets = np.frombuffer(("abcdefghij" * 50 + "xyzw" * 100 + "lorem ipsum dolor " * 20).encode(), dtype=np.uint8), None
    offsets = np.array([0, 300, len(buf)])
    for s, n, f, _ in segments(buf, offsets, 100, 16):
        data = buf[K.ranges(s, n + 99)]
        assert (segment_minimizers(data, n, 100, 16) == f).all()


def test_merged_levels_keep_places():
    words = [b"d", b"a", b"c", b"b", b"a", b"e"]
    family = IndexFamily()
    for i, w in enumerate(words):
        family.add(np.array([w]), np.array([i * 10]))
    for level, places in zip(family.levels, family.places, strict=True):
        assert [words[p // 10] for p in places] == level.tolist()
    assert 40 not in np.concatenate(family.places)
