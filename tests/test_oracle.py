"""Every query against its SQL in DuckDB; those without against plain Python over the same whole tables."""

import re

import duckdb
import pytest

from larkspur import lexicon as L
from larkspur.functions import similarity as S
from larkspur.functions import text as X
from larkspur.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "part", "benchmark", "conversations", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, want.fetchall())
    assert a and len(a) == len(b)
    assert a == b


# Without SQL: string similarities are no DuckDB function.


def titles(db):
    return sorted({norm(t) for (t,) in db.execute("SELECT DISTINCT p_name FROM part").fetchall()})


def norm(t):
    return X.plain_match_norm(t)


def best(query, choices, k, least, score):
    found = sorted((-round(score(query, c), 6), c) for c in choices)
    return [(c, -s, i + 1) for i, (s, c) in enumerate([x for x in found if -x[0] >= least][:k])]


@pytest.mark.parametrize("name,query,least,score", [("fuzzy_ratio_topk", "smal bolt", 0.7, S.indel), ("fuzzy_partial_topk", "bolt", 0.7, S.partial), ("fuzzy_token_set", "bolt small thing", 0.6, S.token_set)])
def test_fuzzy(spark, db, name, query, least, score):
    assert sorted((r.choice, r.score, r["rank"]) for r in QUERIES[name](spark, SF).collect()) == sorted(best(query, titles(db), 5, least, score))


def lossy(t, n):
    return re.sub("([a-z]{%d})[a-z]" % n, r"\1", t)


def test_repair_tokens(spark, db):
    parts = db.execute("SELECT p_partkey, p_name FROM part").fetchall()
    words = sorted({w for _, t in parts for w in norm(t).split()})
    fixed = {w: next(iter(best(w, words, 1, 0.83, S.indel)), None) for _, t in parts for w in lossy(norm(t), 4).split() if len(w) > 2 and w not in words}
    want = {}
    for k, t in parts:
        tokens = lossy(norm(t), 4).split()
        hits = [fixed[w][1] for w in tokens if fixed.get(w)]
        if hits:
            want[k] = (" ".join(fixed[w][0] if fixed.get(w) else w for w in tokens), min(hits))
    assert {r.query_id: (r.repaired, r.confidence) for r in QUERIES["repair_tokens"](spark, SF).collect()} == want


def test_repair_whole_and_spacing(spark, db):
    choices, parts = titles(db), db.execute("SELECT p_partkey, p_name FROM part").fetchall()
    bare: dict[str, str] = {}
    for c in choices:
        bare[c.replace(" ", "")] = c
    memo: dict[str, dict] = {}
    want = {}
    for k, t in parts:
        q = lossy(norm(t), 4)
        if q not in memo:
            found = {c: s for c, s, _ in best(q, choices, 3, 0.82, S.token_set)}
            for c, s, _ in best(q.replace(" ", ""), bare, 3, 0.74, S.indel):
                if s >= 0.86 or (" " not in q and len(q) >= 10):
                    found[bare[c]] = max(s, found.get(bare[c], 0))
            found.pop(q, None)
            memo[q] = found
        want |= {(k, c): s for c, s in memo[q].items()}
    assert {(r.query_id, r.choice): r.score for r in QUERIES["repair_whole"](spark, SF).collect()} == want
    low = {c.replace(" ", ""): c for c in reversed(choices)}
    near = {q: best(q, low, 3, 0.86, S.indel) for q in {norm(t).replace(" ", "") for _, t in parts}}
    got = {(r.query_id, r.original, r.score, r["rank"]) for r in QUERIES["repair_spacing"](spark, SF).collect()}
    assert got == {(k, low[c], s, i) for k, t in parts for c, s, i in near[norm(t).replace(" ", "")]}


def test_segment_compact(spark, db):
    parts = db.execute("SELECT p_partkey, p_name FROM part").fetchall()
    lexicon = {}
    for w in sorted({w for _, t in parts for w in norm(t).split()} | {*L.SEGMENTATION_HINTS, *L.STOPWORDS, *L.FILLERS}, key=lambda w: (-len(w), w)):
        lexicon[X.plain_singular(w)] = w

    def cut(t, i=0):
        if i == len(t):
            return []
        for j in range(len(t), i, -1):
            if t[i:j] in lexicon and (rest := cut(t, j)) is not None:
                return [lexicon[t[i:j]], *rest]

    memo = {}
    for r in QUERIES["segment_compact"](spark, SF).collect():
        t = dict(parts)[r.p_partkey] if not memo else memo["names"][r.p_partkey]
        memo.setdefault("names", dict(parts))
        t = norm(t).replace(" ", "")
        if t not in memo:
            words = cut(t) if len(t) >= 12 else None
            memo[t] = " ".join(words) if words and len(words) > 1 else None
        assert r.segmented == memo[t]


def test_hybrid_search(spark, db):
    """The first hit of a part's name with a letter lost is a part of that name, or its equal in score."""
    rows = QUERIES["hybrid_search"](spark, SF).collect()
    names = dict(db.execute("SELECT p_partkey, p_name FROM part").fetchall())
    asked = {}
    for k, t in sorted(names.items()):
        asked.setdefault(lossy(t, 3), k)
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r)
    assert by.keys() == set(asked.values()) and all([r["rank"] for r in v] == list(range(1, len(v) + 1)) for v in by.values())
    assert all(a.total >= b.total for v in by.values() for a, b in zip(v, v[1:], strict=False))
    assert sum(lossy(v[0].title, 3) == lossy(names[k], 3) for k, v in by.items()) >= 0.95 * len(by)


def test_every_query_is_held_against_something():
    assert set(QUERIES) - set(ORACLE) == {"fuzzy_ratio_topk", "fuzzy_partial_topk", "fuzzy_token_set", "repair_tokens", "repair_whole", "repair_spacing", "segment_compact", "hybrid_search"}
