"""Operator 7 against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest

from larkspur.llm import jaccard, queries
from larkspur.llm.jaccard import Bands, components, deduplicated, jaccard_components, op7_jaccard_join, piece_keys, sketch


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=250):
    r = random.Random(seed)
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A b"), (5, "a c"), (6, "the " * 50), (7, "the " * 60)]
    base = [[r.choice("abcdefgh") + str(r.randint(0, 40)) for _ in range(r.choice([5, 8, 9, 12, 30, 80, 300]))] for _ in range(40)]
    for i in range(8, n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["new"], [w[k], "more"]])
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,chunk", [(1, 2048), (2, 2048), (3, 3)])
def test_components_of_links(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = corpus(seed)
    out = jaccard_components(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, n long"))
    assert out.columns == ["doc_id", "text", "cls", "n", "n_shingles", "component_id"]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == brute(rows)


def test_every_similar_pair_shares_a_key():
    """Without the other steps: keys of similar sets meet, at all sizes and with sets just similar enough."""
    r = np.random.default_rng(5)
    bands = Bands()
    for n in [*range(4, 60), 100, 333, 1000]:
        for _ in range(4):
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            u = r.integers(0, 1 + n // 9)  # leaves out u, adds as many as similarity allows
            added = int((n - u) * 1.25 - n)
            b = np.concatenate([a[u:], r.integers(0, 1 << 63, max(added, 0)).astype(np.uint64)])
            both, union = n - u, n + max(added, 0)
            if 100 * both < 80 * union or (both == union):
                continue
            assert set(jaccard.set_keys(a, bands).tolist()) & set(jaccard.set_keys(b, bands).tolist()), (n, u, added)
            x, y = sketch(a), sketch(b)
            size = min(len(x), len(y))
            far = int(np.bitwise_count(jaccard.folded(x, size) ^ jaccard.folded(y, size)).sum())
            assert far <= n + len(b) - 2 * both
    assert len(piece_keys(np.arange(5, dtype=np.uint64), 3, 3, 1)) <= 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 200: 100, 150: 100}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (1, "other text here with words"), (None, long + " end"), (9, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(0, 47, 1), (1, 1, 1), (1, 46, 1), (1, 46, 1), (9, 0, 9), (9, 0, 9)]
    assert jaccard_components(df.limit(0)).count() == 0
    some = spark.createDataFrame([(1, long), (2, long), (3, ""), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in deduplicated(some).collect()) == [1, 3, 4]


def test_one_of_each_component(spark):
    """Repeated ids, null ids, and the user's columns of any name."""
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long, 7, "p", 0.5, 3), (1, "quite another text of some words", 8, "p", 0.5, 3), (2, long + " z", 9, "p", 0.5, 3), (None, long, 1, "p", 0.5, 3), (None, "only this one has no id", 2, "p", 0.5, 3), (4, "", 3, "p", 0.5, 3), (4, None, 3, "p", 0.5, 3)]
    df = spark.createDataFrame(rows + [rows[0], rows[4]], "doc_id long, text string, k int, spans string, score double, n_shingles int")
    got = sorted(map(tuple, deduplicated(df).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[4], rows[5], rows[6]], key=str) and deduplicated(df).schema == df.schema
    once = df.where("doc_id is not null and k <> 8 and text <> ''").distinct()
    assert [r.doc_id for r in deduplicated(once).collect()] == [1] and deduplicated(once).schema == df.schema
    assert deduplicated(df.limit(0)).count() == 0


def test_op7(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in op7_jaccard_join(spark, sf).collect()) == brute(rows)


def test_op7_sql(spark):
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    rows = sorted(db.execute(queries.ORACLE["op7_jaccard_join"]).fetchall())
    assert rows == brute([(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])
