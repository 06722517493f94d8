"""Search flow on a catalogue written by hand, and its scores against an independent scorer in plain Python."""

import json
import math
import re
import unicodedata
from collections import Counter

import pytest

from larkspur import lexicon as L
from larkspur.errors import ServiceError
from larkspur.functions import similarity as S
from larkspur.functions import text as X
from larkspur.operators import analytics
from larkspur.plans import evaluation
from larkspur.plans.engine import SearchEngine
from larkspur.settings import SETTINGS
from larkspur.sources.catalogue import load_json

COURSES = [
    {"course_id": "c1", "group_id": "g1", "title": "Breastfeeding Basics", "aliases": ["Lactation Basics", "BF intro"], "description": "How to breastfeed a newborn child", "tags": ["lactation", "feeding"], "instructor": "Asha Rao", "language": "English", "category": "Maternal", "topic": "breastfeeding", "difficulty": "beginner", "duration_minutes": 30, "certification": True, "popularity_score": 0.9, "recency_score": 0.4, "levels": ["L1"], "competency_name": "stanya", "metadata": {"unit": "u1"}},
    {"course_id": "c2", "group_id": "g1", "title": "Breastfeeding Basics Tamil", "aliases": ["thaippal"], "description": "Same course for Tamil speakers", "tags": ["lactation"], "instructor": "Asha Rao", "language": "Tamil", "category": "Maternal", "topic": "breastfeeding", "popularity_score": 0.3, "recency_score": 0.6},
    {"course_id": "c3", "title": "Postpartum Depression Support", "aliases": ["ppd help"], "description": "Mood after delivery and mental health", "tags": ["mental health"], "instructor": "Dr. Meera Nair", "language": "English", "category": "Maternal", "topic": "postpartum", "difficulty": "advanced", "duration_minutes": 90, "popularity_score": 0.7, "recency_score": 0.9},
    {"course_id": "c4", "title": "Essential Newborn Care", "aliases": ["ENBC"], "description": "Warmth, feeding and danger signs", "tags": ["newborn"], "instructor": "John Paul", "language": "Hindi", "category": "Neonatal", "topic": "newborn care", "duration_minutes": 45, "popularity_score": 0.8, "recency_score": 0.2},
    {"course_id": "c5", "title": "Kangaroo Mother Care", "aliases": ["KMC"], "description": "Skin contact for low birth weight", "tags": ["newborn", "warmth"], "instructor": "John Paul", "language": "English", "category": "Neonatal", "topic": "newborn care", "popularity_score": 0.5, "recency_score": 0.5},
    {"course_id": "c6", "title": "Ｈａｎｄ Washing", "description": "Clean hands", "instructor": "Li", "language": "English", "category": "Hygiene", "topic": "hygiene", "active": False},
]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("catalogue") / "courses.json"
    p.write_text(json.dumps(COURSES, ensure_ascii=False))
    return str(p)


@pytest.fixture(scope="module")
def engine(spark, path, tmp_path_factory):
    return SearchEngine(spark, load_json(spark, path), str(tmp_path_factory.mktemp("index")), analytics.QueryLog(spark, str(tmp_path_factory.mktemp("log"))))


# Plain Python, written apart from the columns.


def norm(t, match=True):
    t = unicodedata.normalize("NFKC", t or "").lower()
    t = " ".join(L.ABBREVIATIONS.get(w, w) for w in t.split())
    t = re.sub(r"([a-zA-Z])\1{2,}", r"\1\1", t)
    words = re.sub("_+", " ", re.sub(r"[^\w\s]+", " ", t)).split()
    if match:
        words = [w[:-3] + "y" if w.endswith("ies") and len(w) > 4 else w[:-1] if w.endswith("s") and not w.endswith("ss") and len(w) > 3 else w for w in words]
    return " ".join(words)


def toks(t):
    return [w for w in norm(t).split() if w not in L.STOPWORDS]


def soundex(w):
    codes = {c: d for d, cs in zip("123456", ["bfpv", "cgjkqsxz", "dt", "l", "mn", "r"], strict=True) for c in cs}
    w = re.sub("[^a-z]", "", w.lower())
    out, last = w[:1].upper(), ""
    for c in w[1:]:
        d = codes.get(c, "")
        if d and d != last:
            out += d
        last = d or last
    return (out + "000")[:4] if w else ""


def features(t):
    c = norm(t).replace(" ", "")
    return Counter(toks(t) + ([c[i : i + 3] for i in range(len(c) - 2)] if len(c) > 3 else [c] if c else []))


def forms(t):
    n, out = norm(t), {norm(t)}
    has = lambda p: f" {norm(p)} " in f" {n} "
    for k, v in L.ROMANIZED.items():
        if has(k):
            out |= {norm(x) for x in v}
        if any(map(has, v)):
            out.add(norm(k))
    return sorted(x for x in out if x)


def document(c):
    translit = list(dict.fromkeys([*c.get("transliterations", []), *sorted({f for t in [c["title"], *c.get("aliases", []), c.get("competency_name") or ""] for f in forms(t)})]))
    more = [c.get("competency_name") or "", *c.get("levels", []), *c.get("metadata", {}).values()]
    every = [c["title"], *c.get("aliases", []), *c.get("synonyms", []), *translit, c["description"], *c.get("tags", []), c["instructor"], c["topic"], c["category"], c["language"], *more]
    meaning = [c["title"], c["description"], *c.get("tags", []), *c.get("aliases", []), *c.get("synonyms", []), *translit, c["topic"], c["language"], *more]
    return {"all": Counter(toks(" ".join(every))), "title": Counter(toks(c["title"])), "f": features(" ".join(meaning)), "t": norm(c["title"]), "names": [norm(a) for a in c.get("aliases", [])], "body": norm(c["description"])}


def totals(state):
    docs = {c["course_id"]: document(c) for c in COURSES}
    n = len(docs)
    mean = {k: max(1.0, sum(sum(d[k].values()) for d in docs.values()) / n) for k in ("all", "title")}
    out = {}
    text, terms, wanted = state["corrected"] or state["normalized"], state["query_terms"], features(state["semantic_query"])
    for c in COURSES:
        d = docs[c["course_id"]]

        def bm25(k, d=d):
            size = max(sum(d[k].values()), 1)
            s = 0.0
            for t in terms:
                if f := d[k][t]:
                    df = sum(t in x["all"] for x in docs.values())
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / mean[k]))
            return s

        bare, title = text.replace(" ", ""), d["t"].replace(" ", "")
        phrase = max([1.0 * (text in d["body"]), 3.0 * (text == d["t"] or text in d["names"]), 2.6 * (bare == title), 2.4 * (bare in [x.replace(" ", "") for x in d["names"]])])
        near = [S.indel(text, d["t"]), S.partial(text, d["t"]), S.indel(bare, title), S.partial(bare, title)]
        for x in d["names"]:
            near += [S.token_set(text, x), S.indel(bare, x.replace(" ", "")), S.partial(bare, x.replace(" ", ""))]
        dot = sum(w * d["f"][k] for k, w in wanted.items())
        size = math.sqrt(sum(w * w for w in wanted.values()) * sum(w * w for w in d["f"].values()))
        codes = {soundex(t) for t in d["all"]} - {""}
        s = {"lexical": bm25("all"), "title_bm25": bm25("title"), "fuzzy": max(near), "semantic": dot / size if size else 0.0, "phrase": phrase, "phonetic": sum(soundex(t) in codes for t in terms) / max(len(terms), 1),
             "popularity": c.get("popularity_score", 0.0), "recency": c.get("recency_score", 0.0), "language_boost": 1.0 * (norm(c["language"]) in state["languages"])}
        total = sum(s[k] * w for k, w in SETTINGS.weights.items())
        hits = sum(t in d["all"] for t in set(terms))
        proof = hits >= 2 or s["title_bm25"] > 0 or phrase > 0 or s["fuzzy"] >= 0.72 or s["semantic"] >= 0.32 or s["phonetic"] >= 0.5
        rescue = s["fuzzy"] >= 0.78 or (s["semantic"] >= 0.28 and (hits or s["fuzzy"] >= 0.55 or s["phonetic"] >= 0.34 or s["title_bm25"] > 0)) or phrase > 0
        if c.get("active", True) and ((total > 0.35 and proof) or rescue):
            out[c["course_id"]] = total
    return out


ASKED = ["breastfeeding basics", "lactaion basics", "postpartm depresion", "kmc", "newborn care in hindi", "essentialnewborncare", "quantum astrophysics for toddlers", "mood after delivery", "ppd", "asha", "hand washing"]


def test_scores_against_plain_python(spark, engine):
    from larkspur.operators import corrections
    from larkspur.plans import engine as E
    from larkspur.sources.store import materialised

    index = engine.index()
    q = spark.createDataFrame([(i, x) for i, x in enumerate(ASKED)], "query_id int, query string")
    states = materialised(corrections.understood(q, index.choices(), index.table("vocabulary")))
    got: dict[int, dict] = {}
    for r in E.retrieved(index, states).collect():
        got.setdefault(r.query_id, {})[r.course_id] = r.total
    for s in states.collect():
        want = totals(s.asDict())
        fallback = not want and s.corrected and s.corrected != s.normalized
        assert fallback or got.get(s.query_id, {}) == pytest.approx(want, abs=1e-9), s.query
    assert len(got) > 7


def test_repairs_and_decisions(spark, engine):
    from larkspur.operators import corrections

    asked = ["breastfeeding basics", "lactaion basics", "breastfeedingbasics", "essentialnewborncre", "kangaroo mothr care", "newbornfeedinghelp", "zzz"]
    q = spark.createDataFrame([(x, x) for x in asked], "query_id string, query string")
    index = engine.index()
    s = {r.query: r for r in corrections.understood(q, index.choices(), index.table("vocabulary")).collect()}
    first = {r.query_id: r.course_id for r in engine.search_batch(q).where("rank = 1").collect()}
    assert s["breastfeeding basics"].corrected is None and s["breastfeeding basics"].did_you_mean is None and first["breastfeeding basics"] in ("c1", "c2")
    typo = s["lactaion basics"]
    assert typo.corrected == typo.did_you_mean == typo.retrieval == "lactation basic" and first["lactaion basics"] in ("c1", "c2")
    assert [x.confidence for x in typo.repairs] == sorted([x.confidence for x in typo.repairs], reverse=True) and len({x.text for x in typo.repairs}) == len(typo.repairs) and typo.alternates == [x.text for x in typo.repairs[1:4]]
    assert s["breastfeedingbasics"].corrected is None and first["breastfeedingbasics"] in ("c1", "c2")
    assert first["essentialnewborncre"] == "c4" and s["kangaroo mothr care"].search_instead_for == "kangaroo mothr care" and first["kangaroo mothr care"] == "c5"
    assert s["newbornfeedinghelp"].segmented == "newborn feeding help" and s["zzz"].repairs is None and s["zzz"].alternates == []


def test_one_hit_a_group_and_the_preferred_language(engine):
    r = engine.respond("breastfeeding basics in tamil")["results"]
    assert [x["group_id"] for x in r].count("g1") == 1 and r[0]["course_id"] == "c2" and [v["course_id"] for v in r[0]["grouped_variants"]] == ["c1"]
    assert engine.respond("newborn care course for my child", preferred_language="Hindi")["results"][0]["language"] == "Hindi"


def test_response(engine):
    r = engine.respond("lactation basics", filters={"language": "English", "difficulty": None, "duration_max": 60}, debug=True)
    hit = r["results"][0]
    assert r["filters_applied"] == {"language": "English", "duration_max": 60} and {x["language"] for x in r["results"]} == {"English"}
    assert hit["course_id"] == "c1" and hit["metadata"]["competency_name"] == "stanya" and json.loads(hit["metadata"]["levels"]) == ["L1"] and hit["metadata"]["unit"] == "u1"
    assert hit["highlights"]["tags"][0] == "<em>lactation</em>" and hit["debug"]["total"] == pytest.approx(hit["score"], abs=1e-3) and "Exact or normalized title match" in hit["explanations"]
    assert r["facets"]["language"] == {"english": len(r["results"])} and r["pagination"]["total_results"] == len(r["results"]) and r["debug_info"]["query_pipeline"]["normalized_tokens"] == ["lactation", "basic"]
    assert r["extracted_search_intent"]["topics"][0] == "breastfeeding" and r["detected_languages"] == ["English", "english"]
    none = engine.respond("zzzz qqqq", page=2)
    assert none["results"] == [] and none["no_results_guidance"]["message"].startswith("No strong results") and none["pagination"]["total_pages"] == 0
    assert engine.respond("care", page_size=1, cursor="2")["pagination"]["page"] == 2
    for bad, code in (("  ", "empty_query"), ("x" * 241, "query_too_long")):
        with pytest.raises(ServiceError) as e:
            engine.respond(bad)
        assert e.value.code == code and set(e.value.envelope()) == {"schema_version", "request_id", "error"}


def test_suggestions(engine):
    by = {g["section"]: g["items"] for g in engine.suggest_logged("lactaion basics", "Tamil", 4)}
    assert list(by) == ["corrected_query", "course_titles", "topics", "instructors", "language_aware"]
    assert by["corrected_query"][0]["text"] == "lactation basic" and by["corrected_query"][0]["confidence"] == 0.93 and by["language_aware"][0]["text"] == "lactaion basics in Tamil"
    by = {g["section"]: g["items"] for g in engine.suggest("newborn", limit=8)}
    assert by["course_titles"][0]["text"] == "Essential Newborn Care" and by["course_titles"][0]["confidence"] == 0.88 and by["course_titles"][0]["metadata"]["course_id"] == "c4"
    assert {"newborn", "newborn care", "Essential Newborn Care"} == {x["text"] for x in by["related_queries"]} and len(by["topics"]) <= 4


def test_updates(spark, path, tmp_path):
    engine = SearchEngine(spark, load_json(spark, path))
    (tmp_path / "new.json").write_text(json.dumps([COURSES[4] | {"title": "Kangaroo Mother Care renewed"}, COURSES[0] | {"course_id": "c9", "group_id": "g9", "title": "Suture of tears"}]))
    new = load_json(spark, str(tmp_path / "new.json"))
    for _ in range(2):  # the same batch again changes nothing
        assert engine.upsert(new) == 2
        rows = {r.course_id: (r.title, r.doc_seq) for r in engine.catalogue.collect()}
        assert len(rows) == 7 and rows["c5"] == ("Kangaroo Mother Care renewed", 4) and rows["c9"][1] > 5
    assert engine.search("suture of tears").first().course_id == "c9" and engine.health()["dependencies"][0]["details"]["document_count"] == 7
    assert engine.delete(spark.createDataFrame([("c9",), ("nowhere",)], "course_id string")) == 1 and engine.status()["documents"] == 6
    assert "c9" not in [r.course_id for r in engine.search("suture of tears").collect()]
    assert engine.reindex(new) == 2 and engine.status()["documents"] == 2 and engine.reindex(sample=path) == 6 and engine.health("ready")["status"] == "ready"
    with pytest.raises(ServiceError) as e:
        engine.reindex(sample=str(tmp_path / "absent.json"))
    assert e.value.code == "sample_data_missing"
    for verb, code in ((engine.upsert, "empty_index_request"), (engine.delete, "empty_delete_request")):
        with pytest.raises(ServiceError) as e:
            verb(new.limit(0))
        assert e.value.code == code


def test_voice_and_query_log(spark, engine):
    r = engine.voice("um-kangaroo_mother_care.wav", "Audio/WAV; codecs=1", 1000)
    assert r["transcript"] == "kangaroo mother care" and not r["degraded"] and r["search_response"]["results"][0]["course_id"] == "c5"
    bad = engine.voice("um.wav", "audio/x-m4a", 10)
    assert bad["degraded"] and bad["metadata"]["code"] == "stt_unavailable"
    for kind, n, code in (("audio/flac", 1, "unsupported_audio_type"), ("audio/wav", (5 << 20) + 1, "audio_too_large")):
        with pytest.raises(ServiceError) as e:
            engine.voice("a.wav", kind, n)
        assert e.value.code == code
    engine.respond("lactaion basics")
    engine.respond("zzzz qqqq")
    log = engine.log
    assert log.count() >= 4 and log.recent(1).first().query_text == "zzzz qqqq" and log.events("zero_result_events").where("query_text = 'zzzz qqqq'").count() >= 1
    assert log.events("correction_events").where("corrected_query = 'lactation basic'").count() >= 1 and log.events().where("degraded").count() == 1
    assert json.loads(log.recent(1).first().metadata_json)["sort"] == "relevance" and log.health()["status"] == "up"
    assert analytics.QueryLog(spark, "/proc/nowhere").search("q", None, None, 0, 1.0) is None and analytics.QueryLog(spark, "/proc/nowhere").health()["status"] == "degraded"
    top = {r.query_text: r.n for r in analytics.popularity(log.events()).collect()}
    assert top["zzzz qqqq"] >= 1
    groups = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "section string, items array<string>")
    assert analytics.suggestion_count(groups).first().n == 3


def test_evaluation(spark, engine, tmp_path):
    seeds = [(0, "Breastfeeding Basics", "g1", False, ["exact_title"], None), (1, "kmc", "c5", False, ["acronym"], None), (2, "नवजात शिशु देखभाल", "c4", False, ["hindi"], None), (3, "kmc", "c5", False, ["again"], None)]
    q = evaluation.generated(spark.createDataFrame(seeds, f"at long, {evaluation.QUERY_SET}"), ["air fryer recipes", "football live score"])
    rows = [(r.query, tuple(r.tags)) for r in q.orderBy("at", "k").collect()]
    assert rows[:3] == [("Breastfeeding Basics", ("exact_title",)), ("   Breastfeeding   Basics   ", ("exact_title", "generated_extra_spaces")), ("!! Breastfeeding Basics ??", ("exact_title", "generated_punctuation"))]
    assert len(rows) == 6 + 5 + 3 + 2 and ("KMC", ("acronym", "generated_uppercase")) in rows and rows[-1][1] == ("negative_query",)
    evaluation.write_query_set(q, str(tmp_path / "queries"))
    assert spark.read.json(str(tmp_path / "queries")).count() == len(rows)
    r = evaluation.report(engine.index(), q, str(tmp_path / "report"))
    assert r["positive_total"] == 14 and r["negative_total"] == 2 and r["top3_hits"] == 14 and r["top1_hits"] >= 12 and r["negative_passes"] == 2 and r["failures"] == []
    assert r["per_tag"]["negative_query"] == {"count": 2, "top1": 2, "top3": 2}
    assert json.loads(spark.read.text(str(tmp_path / "report")).first()[0])["positive_total"] == 14


def test_sql_functions(spark):
    X.register(spark)
    texts = ["Breast-Feeding  coursesss of babies, nb", "", None, "ab", "naïve Ünï", "Tymczak pfister"]
    spark.createDataFrame([(t,) for t in texts], "s string").createOrReplaceTempView("sql_texts")
    for t, r in zip(texts, spark.sql("SELECT match_norm(s) m, compact(s) c, tokens(s) t, soundex_ref(s) x, indel_ratio(s, 'ab') r FROM sql_texts").collect(), strict=True):
        assert (r.m, r.c, r.t) == (norm(t), norm(t).replace(" ", ""), norm(t).split()) and r.r == S.indel(t, "ab")
        assert r.x == (None if t is None else soundex(t))


def test_guards(spark):
    rows = [("/", None, 200), ("/api/v1/health", None, 200), ("/api/v1/healthy", None, 401), ("/api/v1/search", "", 401), ("/api/v1/search", "bad", 403), ("/api/v1/search", "k1", 200)]
    df = spark.createDataFrame(rows, "path string, api_key string, want int")
    assert df.where(analytics.authorised(df.api_key, df.path, ["k1", "k2"]) != df.want).count() == 0
    who = spark.createDataFrame([("k", "1.1.1.1", "h"), (None, " 1.1.1.1 , 2.2.2.2", "h"), (None, None, "h"), (None, "", None)], "k string, f string, h string")
    got = [r[0] for r in who.select(analytics.identity(who.k, who.f, who.h, analytics.F.lit("/p"))).collect()]
    assert got == ["key:k:/p", "ip:1.1.1.1:/p", "ip:h:/p", "ip:unknown:/p"]
