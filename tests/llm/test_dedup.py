"""Operators 1 and 10 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.substring import deduplicated, op1_substring_dedup, substring_dedup
from larkspur.llm.suffix import IndexFamily, first_of_equal, op10_suffix_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, block int, spans string"


def brute_words(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = {k for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for k in range(a, a + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, match):
    first = {}
    ordered = sorted(rows, key=lambda r: r[0])
    texts = [(t or "").encode() for _, t in ordered]
    out = []
    for (i, _), b in zip(ordered, texts, strict=True):
        gone = set()
        for a in range(len(b) - match + 1):
            s = b[a : a + match]
            if s in first:
                gone.update(range(a, a + match))
            else:
                first[s] = 1
        spans = sum(1 for k in gone if k - 1 not in gone)
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out.append((i, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["a", "Bé", "ccc", "d d", "日本", "x" * 30, "fin."]
    shared = [" ".join(r.choices(vocabulary, k=60)) for _ in range(3)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ab" * 400), (6, "ab" * 90), (7, "the " * 300)]
    for i in range(8, n):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 40))) for _ in range(3)] + r.sample(shared, r.randint(0, 2))
        r.shuffle(parts)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    return rows + [(n + i, rows[-1][1]) for i in range(5)]


@pytest.mark.parametrize("window", [3, 12, 35])
def test_words(spark, window):
    rows = corpus(window)
    docs = spark.createDataFrame([(i, t, 7, "own") for i, t in rows], SCHEMA)
    out = substring_dedup(docs, window)
    assert out.columns == ["doc_id", "text", "block", "n_words", "n_removed", "spans"]
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=str) == brute_words(rows, window)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and r.block == 7 for r in out.collect())


def test_words_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "x a b c"), (None, None)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.text) for r in got) == [(0, 0, ""), (0, 3, "x"), (1, 4, ""), (1, 4, "")]
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0
    docs = spark.createDataFrame([(5, "p q r", 5)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in deduplicated(docs).collect()] == [(5, "p q r", 5)]


def test_index_family():
    import numpy as np

    r = random.Random(1)
    strings = [bytes(r.choices(b"ab\0", k=4)) for _ in range(400)]
    family, seen, expected = IndexFamily(), set(), []
    for s in strings:
        expected.append(s in seen)
        seen.add(s)
    got = []
    for i in range(0, 400, 37):
        got += family.add(np.frombuffer(b"".join(strings[i : i + 37]), dtype="S4")).tolist()
    assert got == expected and len(family.levels) < 9


@pytest.mark.parametrize("match", [20, 100])
def test_bytes(spark, match):
    rows = corpus(match)
    docs = spark.createDataFrame([(i, t, 7, "own") for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.text).hexdigest()) for r in suffix_dedup(docs, match).collect()]
    assert sorted(got, key=str) == brute_bytes(rows, match)


def test_bytes_in_parts(spark, monkeypatch):
    """Long documents are worked on in overlapping parts."""
    import numpy as np

    from larkspur.llm import suffix

    buf = np.frombuffer(("abcdefghij" * 50 + "xyz" * 100).encode(), dtype=np.uint8)
    whole = {int(p) + i for s, n, _, _ in suffix.segments(buf, np.array([0, 300, len(buf)]), 100, 16) for p, m in zip(s, n, strict=True) for i in range(m)}
    cut = {int(p) + i for s, n, _, _ in suffix.segments(buf, np.array([0, 300, len(buf)]), 100, 16, most=128) for p, m in zip(s, n, strict=True) for i in range(m)}
    assert whole == cut == {i for i in range(len(buf) - 99) if not 201 <= i < 300}


def test_queries_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op1_substring_dedup(spark, sf).collect()), key=str) == brute_words(rows, 35)
    assert sorted((tuple(r) for r in op10_suffix_dedup(spark, sf).collect()), key=str) == brute_bytes(rows, 100)
    assert defaultdict(int, ((r.n_spans > 0, 1) for r in op10_suffix_dedup(spark, sf).collect()))[True]


def test_bytes_decide():
    """Two ranges of one hash are equal only if their bytes are."""
    data = np.frombuffer(b"abcabcabdab", dtype=np.uint8)
    at, size = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2])
    assert first_of_equal(np.full(4, 7, dtype=np.uint64), data, at, size).tolist() == [True, False, True, True]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=30), max_size=12))
def test_family_of_levels(batches):
    """What has come before, over batches of any size; levels stay sorted, distinct and geometric."""
    family, seen = IndexFamily(), set()
    for b in batches:
        strings = np.array([f"{x:03d}".encode() for x in b], dtype="S3")
        got, want = family.add(strings).tolist() if b else [], []
        for x in b:
            want.append(x in seen)
            seen.add(x)
        assert got == want
    assert all((a[1:] > a[:-1]).all() for a in family.levels) and sum(map(len, family.levels)) == len(seen)
    assert all(len(a) >= 2 * len(b) for a, b in zip(family.levels, family.levels[1:], strict=False))


def test_bytes_of_rows_with_null_and_equal_ids(spark):
    """Null ids come last; rows with equal ids by block, then text, whichever comes first keeps what both have."""
    t = "".join(chr(97 + i % 26) + str(i) for i in range(120))
    rows = [(None, t), (5, t + "x"), (5, t + "x"), (2, "zz" + t), (None, t)]
    out = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in out)
    n = len(t)
    assert gone == [(2, 0), (5, n), (5, n + 1), (99, n), (99, n)]
