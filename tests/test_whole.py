"""Nothing is left out: fuzzy candidates against brute force over all pairs."""

import json
import math

import pytest

from larkspur.functions import similarity as S
from larkspur.operators import repair
from larkspur.plans import engine
from larkspur.plans.queries import QUERIES
from larkspur.sources.catalogue import load_json

LONG = ["lactation counselor program", "advanced thunderbolts and their uses", "bolt", "bolted joints of large machines", "care of the newborn child", "child newborn care", "boltt boltt boltt", "xylophone", "care"]
ASKED = ["lactaion", "bolt", "newbrn care", "cxaxrxe", "boltt", "program lactation", "nd"]


@pytest.mark.parametrize("scorer,plain,least", [(S.indel_ratio, S.indel, 0.7), (S.indel_ratio, S.indel, 0.5), (S.partial_ratio, S.partial, 0.7), (S.token_set_ratio, S.token_set, 0.7), (S.token_set_ratio, S.token_set, 0.3)])
def test_matches_are_whole(spark, scorer, plain, least):
    qs = spark.createDataFrame([(q, q) for q in ASKED], "query_id string, query string")
    cs = spark.createDataFrame([(c,) for c in LONG], "choice string")
    got = {(r.query, r.choice, r.score) for r in repair.best_matches(qs, cs, 100, least, scorer).collect()}
    assert got == {(q, c, round(plain(q, c), 6)) for q in ASKED for c in LONG if round(plain(q, c), 6) >= least}


def catalogue(spark, rows):
    base = [(str(i), str(i), i, t, "", "", "", "", "", None, None, None, 0.0, 0.0, True) for i, t in enumerate(rows)]
    return spark.createDataFrame(base, "course_id string, group_id string, doc_seq long, title string, body string, instructor string, topic string, category string, language string, difficulty string, duration_minutes int, certification boolean, popularity double, recency double, active boolean")


def test_search_finds_typo_in_long_title(spark):
    found = engine.SearchEngine(spark, catalogue(spark, LONG)).search("lactaion").collect()
    assert found and found[0].title == "lactation counselor program"
    assert "Typo-tolerant fuzzy match" in found[0].explanations


COURSES = [
    {"course_id": "a", "title": "Bleeding after birth", "aliases": ["PPH bundle", "Motive approach"], "description": "What to do", "language": "English"},
    {"course_id": "b", "title": "Warmth", "tags": ["hypothermia"], "description": "Keep dry", "language": "English", "metadata": {"unit": "thermoregulation"}},
    {"course_id": "c", "title": "Feeding", "transliterations": ["stanpan"], "synonyms": ["nursing"], "description": "Milk", "language": "Hindi"},
    {"course_id": "d", "title": "Handling of tools", "description": "Bolts", "language": "English", "levels": ["nurse"], "competency_name": "maintenance"},
]


FIRST = {"motive approach": "a", "motiveapproach": "a", "motve aproach": "a", "hypothermia": "b", "thermoregulation": "b", "stanpan": "c", "nursing": "c", "maintenance": "d"}


def test_search_by_every_column(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(COURSES))
    asked = spark.createDataFrame([(x, x) for x in FIRST], "query_id string, query string")
    found = engine.SearchEngine(spark, load_json(spark, str(tmp_path / "c.json"))).search_batch(asked).where("rank = 1").collect()
    assert {r.query_id: r.course_id for r in found} == FIRST


def test_fuzzy_is_best_of_seven(spark):
    rows = [("a", "bleeding after birth", ["pph bundle", "motive approach"]), ("b", "warmth", []), ("c", "care of newborn", ["newborn"])]
    flat = [(i, n, n.replace(" ", ""), k == 0) for i, title, names in rows for k, n in enumerate([title, *names])]
    asked = ["pphbundle", "motve", "bundle pph x", "warmt", "birth bleeding"]
    q = spark.createDataFrame([(x, x) for x in asked], "query_id string, text string")
    want = {}
    for x in asked:
        y = x.replace(" ", "")
        for id, title, names in rows:
            t = title.replace(" ", "")
            seven = [S.indel(x, title), S.partial(x, title), S.indel(y, t), S.partial(y, t)]
            for n in names:
                m = n.replace(" ", "")
                seven += [S.token_set(x, n), S.indel(y, m), S.partial(y, m)]
            want[x, id] = max(seven)
    got = engine.by_likeness(spark.createDataFrame(flat, "course_id string, norm string, compact string, title boolean"), q)
    assert {(r.query_id, r.course_id): r.fuzzy for r in got.collect()} == pytest.approx({k: v for k, v in want.items() if v})


def test_whole_repairs_without_spaces(spark):
    qs = spark.createDataFrame([(0, "smallboltx"), (1, "smaltwidgt"), (2, "small bolt"), (3, "smalbl")], "query_id int, query string")
    cs = spark.createDataFrame([("small bolt",), ("small widget",), ("large nut",)], "choice string")
    got = {(r.query_id, r.choice) for r in repair.whole_repairs(qs, cs).collect()}
    assert {(0, "small bolt"), (1, "small widget")} <= got and not {(2, "small bolt"), (3, "small bolt")} & got


def test_segmentation_has_no_cap(spark):
    vocabulary = spark.range(150_000).selectExpr("concat('w', id, 'z') AS term").unionByName(spark.createDataFrame([("small",), ("widget",), ("bolt",)], "term string"))
    asked = ["w149999zw0zsmall", "smallwidgetbolt", "smallwidgetqqq", "short", ""]
    got = repair.segmented(spark.createDataFrame([(x,) for x in asked], "query string"), vocabulary, ["bolt"]).collect()
    assert {r["query"]: r.segmented for r in got} == dict(zip(asked, ["w149999z w0z small", "small widget bolt", None, None, None], strict=True))


def test_batch_uses_all_tokens(spark, tmp_path):
    words = [f"wo{chr(97 + i)}" for i in range(12)]
    docs = [(i, " ".join(words[(i * j * j + j) % 12] for j in range(6 + i % 5)), "en" if i % 2 else "de", "web") for i in range(30)]
    asked = [(1, " ".join(words[:9])), (2, " ".join(words[4:] + words[:3] + words[9:]))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = {i: t.split() for i, t, *_ in docs}
    mean = sum(map(len, texts.values())) / 30
    want = set()
    for q, text in asked:
        scores = {}
        for i, t in texts.items():
            for x in text.split():
                if n := t.count(x):
                    df = sum(x in u for u in texts.values())
                    scores[i] = scores.get(i, 0) + math.log(1 + (30 - df + 0.5) / (df + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(t) / mean))
        best = sorted(scores, key=lambda i: (-round(scores[i], 4), i))[:10]
        want |= {(q, i, round(scores[i], 4), r) for r, i in enumerate(best, 1)}
    assert {tuple(r) for r in QUERIES["bm25_batch_queries"](spark, str(tmp_path)).collect()} == want
    tags = {i: tag for i, _, tag, _ in docs}
    hits = [(tags[i], r) for _, i, _, r in want if r <= 3]
    got = {r.tag: (r.hits, r.top1) for r in QUERIES["eval_topk_by_tag"](spark, str(tmp_path)).collect()}
    assert got == {t: (sum(t == u for u, _ in hits), sum(t == u and r == 1 for u, r in hits)) for t in {t for t, _ in hits}}


def test_cosine_joins_nothing_that_grows(spark):
    """Only the query's features are joined, however small the documents seem to the planner; ids that are null or repeated are as in SQL."""
    docs = spark.createDataFrame([(1, "small red bolt"), (2, "red paint"), (2, "small tin"), (None, "small red bolt"), (3, None), (4, "zzz")], "id int, name string")
    asked = spark.createDataFrame([(0, "small red bolt"), (1, "tin")], "query_id int, text string")
    got = engine.cosine(spark.createDataFrame(docs.collect(), docs.schema).coalesce(1), "id", "name", asked, "text")
    values = spark.sql("SELECT * FROM VALUES (1, 'small red bolt'), (2, 'red paint') AS t(id, name)")  # a size that the planner knows
    plan = engine.cosine(values, "id", "name", asked, "text")._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.split("\n") if "Join " in x]) == 1
    have = {(r.query_id, r.id): r.semantic for r in got.collect()}
    assert set(have) == {(0, 1), (0, 2), (1, 2)} and have[0, 1] == 1.0
    counts = {}
    for name in ("red paint", "small tin"):
        bare = name.replace(" ", "")
        for f in [*name.split(), *(bare[i : i + 3] for i in range(len(bare) - 2))]:
            counts[f] = counts.get(f, 0) + 1
    assert have[1, 2] == round(counts["tin"] * 2 / math.sqrt(sum(x * x for x in counts.values())) / 2, 4)
