"""Operators 6 and 9: held-out accuracy, segments against brute force, rules against their expressions; and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from larkspur.llm import queries, rules, toxicity
from larkspur.llm.labelled import sample
from test_jaccard import brute

SF = "/root/testdata/sf0.1"


def labelled(spark, sf, label):
    return {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def test_as_many_rules_as_there_can_be(spark):
    """A model of all 14 rules of each of the 40 trees scores, and as numpy adds them up."""
    r = np.random.default_rng(5)
    x = r.random((50, len(rules.STATISTICS)))
    some = [tuple((int(j), bool(r.integers(2)), float(r.random())) for j in r.integers(len(rules.STATISTICS), size=1 + k % 3)) for k in range(560)]
    m = rules.RuleModel(0.1, [(q, float(w)) for q, w in zip(some, r.normal(size=560) / 10, strict=True)])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], rules.STATISTICS)
    want = 1 / (1 + np.exp(-(m.intercept + sum(w * rules.holds(q, x) for q, w in m.rules))))
    assert np.allclose([s.score for s in df.select(m.column().alias("score")).collect()], want)


@pytest.mark.parametrize("name,label,least", [("op6_toxicity", "toxic", 0.97), ("op9_quality", "quality", 0.98)])
def test_held_out(spark, name, label, least):
    y = labelled(spark, SF, label)
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in y]
    assert len(held) > 700 and sum(r.predicted == y[r.doc_id] for r in held) / len(held) >= least


def test_segments():
    r = random.Random(2)
    for _ in range(200):
        s = np.array([r.choice([-3, -1, -0.5, 0.7, 2]) for _ in range(r.randint(0, 14))])
        sums = {(i, j): s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        assert toxicity.best_segment(s) == pytest.approx(max([0, *sums.values()]))
        got = toxicity.maximal_segments(s)

        def brute(lo, hi, sums=sums):
            own = {k: v for k, v in sums.items() if lo <= k[0] and k[1] <= hi and v > 1e-9}
            if not own:
                return []
            best = max(own.values())
            a, b = min((k for k, v in own.items() if abs(v - best) < 1e-9), key=lambda k: k[1] - k[0])
            return [*brute(lo, a), best, *brute(b, hi)]

        assert sorted(round(x[2], 6) for x in got) == pytest.approx(sorted(round(float(x), 6) for x in brute(0, len(s))))


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, "you awful scoundrel " * (i % 2) + f"plain words here {i}", "x") for i in range(60)], "doc_id long, text string, passages string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "awful scoundrel " * 9, "x")], docs.schema)
    got = toxicity.score_toxicity(odd, m).collect()
    assert got[2].score > 0.5 and got[2].passages and got[0].score == got[1].score < 0.5
    assert toxicity.score_toxicity(odd.limit(0), m).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd, none).collect()} == {0.5}


def plain_words(text):
    """Words and their beginnings, found apart from the operator."""
    data = (text or "").lower().encode() if (text or "").isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [(w, w[:5], w[:7]) for w in re.findall(rb"[0-9a-z\x80-\xff]+", data)]


def test_toxicity_query_against_plain_python(spark):
    """op6's scores from the fitted model, word by word; and the model's log-odds from counts in plain Python."""
    sf = "/root/testdata/sf0.01"
    model = toxicity.trained(spark, sf)
    known = dict(zip(model.tokens.tolist(), model.scores.tolist(), strict=True))
    rows = {r.doc_id: r for r in queries.QUERIES["op6_toxicity"](spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        h, _ = toxicity.tokens(pa.array([text or ""]))
        assert h.shape[1] == len(plain_words(text))
        best = here = 0.0
        for column in h.T.tolist():
            x = max((known.get(k, 0.0) for k in column), key=abs) - model.drift
            here = max(0.0, here + x)
            best = max(best, here)
        e = min(40.0, max(-20.0, model.lam * best - math.log(h.shape[1] + 1)))
        want = 1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * e)))
        assert rows[i].score == pytest.approx(want, abs=1e-9) and rows[i].predicted == (rows[i].score >= 0.5)
    y = {}
    for i, v in labelled(spark, sf, "toxic").items():
        if zlib.crc32(str(i).encode()) % 5 and v is not None and i in docs:
            y[docs[i] or ""] = max(v, y.get(docs[i] or "", 0))
    n = [sum(v == k for v in y.values()) for k in (0, 1)]
    seen = [Counter(), Counter()]
    for text, v in y.items():
        seen[v].update({w for words in plain_words(text) for w in [(0, words[0]), (5, words[1]), (7, words[2])]})
    want = []
    for t in seen[0].keys() | seen[1].keys():
        y0, y1 = seen[0][t], seen[1][t]
        if y0 + y1 >= 4:
            a = 20 * (y0 + y1) / sum(n)
            d = math.log((y1 + a) / (n[1] + 20.5 - y1 - a)) - math.log((y0 + a) / (n[0] + 20.5 - y0 - a))
            e = math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
            if abs(d) > 2.5 * e:
                want.append(math.copysign(min(abs(d) - 2.5 * e, 8.0), d))
    assert sorted(model.scores.tolist()) == pytest.approx(sorted(want), abs=1e-9)


def test_quality_query_against_plain_python(spark):
    """op9's scores as the sum of rules over statistics computed apart, text by text."""
    sf = "/root/testdata/sf0.01"
    model = rules.trained(spark, sf)
    rows = {r.doc_id: r for r in queries.QUERIES["op9_quality"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        s = plain_statistics(r.text or "")
        z = model.intercept + sum(w for q, w in model.rules if all(s[j] <= t if low else s[j] > t for j, low, t in q))
        assert rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert rows[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and rows[r.doc_id].predicted == (rows[r.doc_id].score >= 0.7)


def plain_statistics(text):
    b = text.encode()
    n, words = len(b), re.findall(rb"[^\x20\x09-\x0d]+", b)
    m = len(words)
    if not n or not m:
        return [float(n), 0.0, *[0.0] * 5, 1.0 if n else 0.0, *[0.0] * 15]
    share = lambda chars: sum(x in chars for x in b)
    symbol = lambda x: 33 <= x < 127 and not chr(x).isalnum()
    lines = [x for x in b.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:], strict=False))
    size = [len(w) for w in words]
    return [
        n, m, sum(size) / m, max(size), sum(x >= 128 or chr(x).isalpha() for x in b) / n, share(b"0123456789") / n, sum(map(symbol, b)) / n, share(b" \t\n\v\f\r") / n, sum(65 <= x <= 90 for x in b) / n, sum(x >= 192 for x in b) / n,
        len(lines), m / len(lines), len(set(words)) / m, len(set(pairs)) / len(pairs) if pairs else 1.0, len(set(lines)) / len(lines), max(Counter(words).values()) / m, sum(x <= 3 for x in size) / m,
        sum(len(w) > 1 and symbol(w[-2]) for w in words) / m, sum(48 <= w[0] <= 57 for w in words) / m, share(b".!?") / m, share(b",;:") / m, share(b"#$%&*|~^=@+_") / m, share(b"<>{}[]()/\\") / m,
    ]


def test_samples_are_bounded_in_rows(spark):
    """Ids and texts that repeat count once."""
    docs = spark.range(5000).selectExpr("id % 2 as doc_id", "concat('text ', id % 7) as text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, toxic int")
    assert sample(docs, labels, "toxic", 10).count() <= 2 and sample(docs, labels, "toxic", 1).count() == 1


def test_rules(spark):
    r = np.random.default_rng(1)
    x = r.random((800, len(rules.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    m = rules.fit_rules(x, y)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x[:200]], rules.STATISTICS)
    got = np.array([s[0] for s in df.select(m.column()).collect()])
    want = 1 / (1 + np.exp(-(m.intercept + sum(w * rules.holds(q, x[:200]) for q, w in m.rules))))
    assert np.allclose(got, want) and ((got > 0.5) == y[:200]).mean() > 0.97 and len(m.rules) < 80
    assert rules.fit_rules(x[:0], y[:0]).rules == []
    odd = spark.createDataFrame([(1, None, 2), (1, "", 2), (None, " \n ", 2), (2, "w" * 5000, 2)], "doc_id long, text string, q_bytes int")
    assert rules.score_quality(odd, m).where("score between 0 and 1").count() == 4 and rules.score_quality(odd.limit(0), m).count() == 0


def test_substring_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["op1_substring_dedup"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(c.execute(queries.ORACLE["op1_substring_dedup"]).fetchall())


def plain_toxicity(model, text):
    known = dict(zip(model.tokens.tolist(), model.scores.tolist(), strict=True))
    h, _ = toxicity.tokens(pa.array([text or ""]))
    best = here = 0.0
    for column in h.T.tolist():
        here = max(0.0, here + max((known.get(k, 0.0) for k in column), key=abs) - model.drift)
        best = max(best, here)
    return 1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * min(40.0, max(-20.0, model.lam * best - math.log(h.shape[1] + 1))))))


def plain_quality(model, text):
    s = plain_statistics(text or "")
    return 1 / (1 + math.exp(-model.intercept - sum(w for q, w in model.rules if all(s[j] <= t if low else s[j] > t for j, low, t in q))))


def plain_stages(toxic, good, rows):
    """What each of the first four stages keeps of rows (id, text) with distinct ids, in plain Python."""
    now = [(i, t) for i, t in rows if plain_toxicity(toxic, t) < 0.5]
    yield now
    now = [(i, t) for i, t in now if plain_quality(good, t) >= 0.7]
    yield now
    kept = {i for i, n, c in brute(now) if not n or c == i}
    now = [(i, t) for i, t in now if i in kept]
    yield now
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in now]
    seen = Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
    out = []
    for (i, _), w in zip(now, split, strict=True):
        gone = {x for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    yield out


def test_pipeline(spark, tmp_path):
    """Each stage's rows, and the packing of the last, against plain Python."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_stages(toxicity.trained(spark, sf), rules.trained(spark, sf), rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        last = sorted(next(want))
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == last, name
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, sf).collect()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in last}
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed) == sorted(
        (i, a, b - a, zlib.crc32(np.array(x[a:b], dtype="<u4").tobytes())) for i, x in ids.items() for a, b in zip([0, *range((len(x) - 1) % 2048 + 1, len(x), 2048)], [*range((len(x) - 1) % 2048 + 1, len(x), 2048), len(x)], strict=True)
    )
    used = Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= sum(used.values()) / 2048 * 1.01 + 1


def test_pipeline_odd_rows(spark):
    """Nulls, empty texts, repeated rows and ids, and columns of the operators' own names, in every stage."""
    sf = "/root/testdata/sf0.001"
    some = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(6).collect()]
    rows = [(1, some[0]), (1, some[1]), (1, some[1]), (None, some[2]), (None, None), (2, ""), (2, None), (3, some[3] + " " + "word " * 20_000), (4, some[4])]
    schema = "doc_id long, text string, score string, passages string, q_bytes string, n_shingles string, component_id string, spans string, n_words string, k string, cls string, id string, rest string, block string"
    docs = spark.createDataFrame([(i, t, *[f"own {c}" for c in range(12)]) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all(tuple(r)[2:] == tuple(f"own {c}" for c in range(12)) for r in kept), name
        assert {(r.doc_id, r.text) for r in kept} <= {(r.doc_id, r.text) for r in docs.collect()} or name == "substring dedup"
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.STAGES[2][1](spark, docs, sf).collect()) == [0, 0, 1, 1, 2, 2, 3, 4]
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() > len(rows) and corpus_pipeline.STAGES[4][1](spark, docs.limit(0), sf).count() == 0
