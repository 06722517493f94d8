"""The queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import lexicon as L
from larkspur.functions import similarity as S
from larkspur.functions import text as X
from larkspur.operators import analytics, index, lexical, rank, repair, results
from larkspur.plans import engine
from larkspur.plans import sqltext as D
from larkspur.sources.catalogue import of_documents, of_parts, spread
from larkspur.sources.store import StoredIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TEXT_QUERY = "license version thing of them"
PART_QUERY = "small red bolt"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and text of all documents, on all cores."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


PARTS = """p AS (SELECT p_partkey AS course_id, p_partkey AS doc_seq, p_name AS title, p_name AS group_id, p_brand AS instructor, p_type AS category, p_type AS topic, 'English' AS language,
  CASE WHEN p_size % 3 <> 0 THEN CASE WHEN p_size > 25 THEN 'advanced' ELSE 'beginner' END END AS difficulty, p_size AS duration_minutes, CASE WHEN p_size % 5 <> 0 THEN p_size % 2 = 0 END AS certification,
  p_retailprice AS popularity, p_size / 50.0 AS recency, p_size <> 13 AS active FROM part)"""
DOCS = "d AS (SELECT doc_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS title, text AS body, lang AS language, source AS topic FROM documents)"

# Text functions


@query(f"SELECT p_partkey, {D.norm('p_name')} AS norm FROM part")
def text_normalize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.normalize_text(F.col("p_name")).alias("norm"))


@query(f"SELECT item_id, {D.compact('text')} AS compacted FROM benchmark")
def text_compact(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.compact(F.col("text")).alias("compacted"))


@query(f"SELECT item_id, array_to_string({D.tokens('text')}, '|') AS tokens FROM benchmark")
def text_tokens(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.tokens(F.col("text")), "|").alias("tokens"))


@query(f"SELECT item_id, array_to_string({D.tokens('text', False)}, '|') AS tokens FROM benchmark")
def text_stopword_filter(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.tokens(F.col("text"), False), "|").alias("tokens"))


@query(f"SELECT p_partkey, {D.match('p_name')} AS phrase FROM part")
def text_singularize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.singular_phrase(X.normalize(F.col("p_name"))).alias("phrase"))


@query(f"WITH c AS (SELECT p_partkey, {D.compact('p_name')} AS t FROM part) SELECT p_partkey, CASE WHEN length(t) <= 3 THEN t ELSE array_to_string(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)), '|') END AS grams FROM c")
def text_char_trigrams(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.trigrams(F.col("p_name")), "|").alias("grams"))


@query(f"WITH t AS (SELECT DISTINCT unnest({D.tokens('text')}) AS term FROM documents) SELECT term, {D.soundex('term')} AS code FROM t")
def text_soundex(spark, sf):
    terms = index.terms_of(texts(spark, sf), X.tokens(F.col("text"))).distinct()
    return terms.select("term", X.soundex_ref(F.col("term")).alias("code"))


@query(f"SELECT conv_id, turn, {D.fillers('text')} AS cleaned FROM conversations")
def text_remove_fillers(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.remove_fillers(F.col("text")).alias("cleaned"))


def _languages(e: str) -> str:
    asked = " , ".join(f"CASE WHEN list_has_any({D.tokens(e)}, {D.items(v)}) THEN '{k}' END" for k, v in L.LANGUAGES.items())
    return f"list_filter([{asked}], lambda x: x IS NOT NULL)"


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_concat({_languages('text')}, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN ['english'] ELSE [] END))), ',') AS languages FROM benchmark")
def lang_detect(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.languages(F.col("text")), ",").alias("languages"))


@query(f"SELECT item_id, len({_languages('text')}) >= 2 AS mixed FROM benchmark")
def code_mixed(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.code_mixed(F.col("text")).alias("mixed"))


_SAID = [(-1, "breast feeding basics in Tamil"), (-2, "newborn care"), (-3, "kmc samajh"), (-4, "family planning lam"), (-5, "नवजात शिशु"), (-6, ""), (-7, "advanced c section after post partum depression")]
_SAID_SQL = "(SELECT item_id::BIGINT AS item_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {D.q(t)})" for i, t in _SAID) + ") v(i, t))"


def _said(spark, sf):
    """All benchmark texts, and some that hold words of the fixed lists."""
    return table(spark, sf, "benchmark").select("item_id", "text").unionByName(spark.createDataFrame(_SAID, "item_id long, text string"))


def _synonyms_sql() -> str:
    cases = ", ".join(f"CASE WHEN contains(j, {D.q(k)}) THEN {D.tokens(D.q(' '.join(v)))} ELSE [] END" for k, v in L.SYNONYMS.items())
    return f"WITH t AS (SELECT item_id, {D.tokens('text', False)} AS w, array_to_string({D.tokens('text', False)}, ' ') AS j FROM {_SAID_SQL} s) SELECT item_id, array_to_string(list_sort(list_distinct(flatten([w, {cases}]))), '|') AS terms FROM t"


def _romanized_sql() -> str:
    has = lambda p: f"contains(' ' || m || ' ', ' ' || {D.match(D.q(p))} || ' ')"
    there = [f"CASE WHEN {has(k)} THEN [{', '.join(D.match(D.q(x)) for x in v)}] ELSE [] END" for k, v in L.ROMANIZED.items()]
    back = [f"CASE WHEN {' OR '.join(map(has, v))} THEN [{D.match(D.q(k))}] ELSE [] END" for k, v in L.ROMANIZED.items()]
    return f"WITH t AS (SELECT item_id, {D.match('text')} AS m FROM {_SAID_SQL} s) SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(flatten([[m], {', '.join(there + back)}])), lambda x: x <> '')), '|') AS forms FROM t"


@query(_synonyms_sql())
def synonym_expand(spark, sf):
    b = _said(spark, sf)
    return b.select("item_id", F.array_join(X.synonyms(X.tokens(F.col("text"), False)), "|").alias("terms"))


@query(_romanized_sql())
def translit_expand(spark, sf):
    return _said(spark, sf).select("item_id", F.array_join(X.romanized_forms(X.match_norm(F.col("text"))), "|").alias("forms"))


@query("SELECT * FROM (VALUES ('pph_primary_management.wav', 'pph primary management', 0.64::DOUBLE), ('a/um-newborn_care.mp3', 'newborn care', 0.64::DOUBLE)) t(path, transcript, confidence)")
def voice_mock_transcript(spark, sf):
    d = spark.createDataFrame([("pph_primary_management.wav",), ("a/um-newborn_care.mp3",)], "path string")
    return d.select("path", analytics.mock_transcript(F.col("path")).alias("transcript"), F.lit(0.64).alias("confidence"))


# Index

TF = f"tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({D.tokens('text')}) AS term FROM documents) GROUP BY 1, 2)"
LEN = f"len AS (SELECT doc_id, len({D.tokens('text')})::BIGINT AS doc_len FROM documents)"


@query(f"WITH {TF} SELECT * FROM tf")
def index_term_freq(spark, sf):
    return index.postings(texts(spark, sf), "doc_id", F.col("text"))


@query(f"WITH {TF}, n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*)::BIGINT AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf, n GROUP BY term")
def index_doc_freq_idf(spark, sf):
    d = texts(spark, sf)
    return index.idf(index.postings(d, "doc_id", F.col("text")), d.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {LEN} SELECT round(greatest(avg(doc_len), 1.0), 4) AS avg_len, count(*)::BIGINT AS n FROM len")
def index_avg_len(spark, sf):
    return index.average_length(index.lengths(texts(spark, sf), "doc_id", F.col("text"))).select(F.round("avg_len", 4).alias("avg_len"), "n")


@query(f"SELECT DISTINCT unnest({D.tokens('p_name')}) AS term FROM part")
def index_vocabulary(spark, sf):
    return index.vocabulary(table(spark, sf, "part"), F.col("p_name"))


@query(f"SELECT DISTINCT {D.match('p_name')} AS choice FROM part")
def index_title_choices(spark, sf):
    return index.title_choices(table(spark, sf, "part"), F.col("p_name"))


@query("""WITH m AS (SELECT max(p_partkey) AS top FROM part), f AS (SELECT min(least(CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE 1000000000000000000 END, CASE WHEN p_partkey % 7 = 0 THEN p_partkey ELSE 1000000000000000000 END)) AS lo FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name, p_partkey AS seq FROM part UNION ALL SELECT p_partkey + 10000000, p_name, p_partkey - lo + top + 1 FROM part, m, f WHERE p_partkey % 7 = 0""")
def upsert_last_wins(spark, sf):
    """The batch's own sequence numbers are as small as the corpus's, as in a file that is loaded."""
    p = table(spark, sf, "part")
    base = p.select("p_partkey", "p_name", F.col("p_partkey").alias("seq"))
    batch = p.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("new "), "p_name").alias("p_name"), F.col("p_partkey").alias("seq"))
    more = p.where("p_partkey % 7 = 0").select((F.col("p_partkey") + 10000000).alias("p_partkey"), "p_name", F.col("p_partkey").alias("seq"))
    return index.upsert(base, batch.unionByName(more), "p_partkey", "seq")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 4 <> 1")
def delete_anti(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return index.delete(p, p.where("p_partkey % 4 = 1"), "p_partkey")


# Scores


def _terms(spark, text: str) -> DataFrame:
    one = spark.createDataFrame([(0, text)], "query_id long, text string")
    return one.select("query_id", F.explode(X.tokens(F.col("text"), False)).alias("term"))


def _bm25_sql(terms: str, field: str, extra: str = "", rank_: str = "") -> str:
    return f"""WITH {DOCS}, b AS (SELECT doc_id, unnest({D.tokens('body')}) AS term FROM d), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM b GROUP BY term),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({D.tokens(field)}) AS term FROM d) GROUP BY ALL), len AS (SELECT doc_id, len({D.tokens(field)}) AS n FROM d), s AS (SELECT greatest(avg(n), 1.0) AS a, count(*) AS c FROM len),
{terms}, x AS (SELECT query_id, doc_id, round(sum(ln(1 + (c - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(n, 1) / a))), 4) AS score FROM q JOIN df USING (term) JOIN f USING (term) JOIN len USING (doc_id), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10"""


_ONE = f"q AS (SELECT 0 AS query_id, unnest({D.tokens(D.q(TEXT_QUERY), False)}) AS term)"
_MANY = f"q AS (SELECT item_id AS query_id, unnest({D.tokens('text', False)}) AS term FROM benchmark)"


@query(_bm25_sql(_ONE, "body"))
def bm25_topk(spark, sf):
    return lexical.top(lexical.bm25(of_documents(spark, sf), "doc_id", F.col("body"), _terms(spark, TEXT_QUERY)), 10, "doc_id").select(F.col("query_id").cast("int"), "doc_id", "score", "rank")


@query(_bm25_sql(_ONE.replace(D.q(TEXT_QUERY), "'the of and thing'"), "title"))
def bm25_title_topk(spark, sf):
    scores = lexical.bm25(of_documents(spark, sf), "doc_id", F.col("body"), _terms(spark, "the of and thing"), F.col("title"))
    return lexical.top(scores, 10, "doc_id").select(F.col("query_id").cast("int"), "doc_id", "score", "rank")


@query(_bm25_sql(_MANY, "body"))
def bm25_batch_queries(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(X.tokens(F.col("text"), False)).alias("term"))
    return lexical.top(lexical.bm25(of_documents(spark, sf), "doc_id", F.col("body"), terms), 10, "doc_id").select("query_id", "doc_id", "score", "rank")


@query(f"WITH {_ONE}, {TF} SELECT doc_id, count(DISTINCT term)::BIGINT AS matched, string_agg(DISTINCT term, ' ' ORDER BY term) AS matched_terms FROM tf JOIN q USING (term) GROUP BY doc_id")
def matched_terms(spark, sf):
    return engine.matched(texts(spark, sf), "doc_id", "text", _terms(spark, TEXT_QUERY)).select("doc_id", "matched", F.array_join("matched_terms", " ").alias("matched_terms"))


@query(f"WITH {_ONE}, n AS (SELECT count(*) AS n FROM q), c AS (SELECT DISTINCT doc_id, {D.soundex('term')} AS code FROM (SELECT doc_id, unnest({D.tokens('text')}) AS term FROM documents)) SELECT doc_id, round(count(*) / any_value(n), 4) AS phonetic FROM c JOIN (SELECT {D.soundex('term')} AS code FROM q) k USING (code), n WHERE code <> '' GROUP BY doc_id")
def phonetic_score(spark, sf):
    return engine.phonetic(texts(spark, sf), "doc_id", "text", _terms(spark, TEXT_QUERY)).select("doc_id", "phonetic")


def _features(e: str) -> str:
    c = D.compact(e)
    return f"list_concat({D.tokens(e, False)}, CASE WHEN {c} = '' THEN [] WHEN length({c}) <= 3 THEN [{c}] ELSE list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3)) END)"


@query(f"""WITH f AS (SELECT p_partkey, f, count(*) AS w FROM (SELECT p_partkey, unnest({_features('p_name')}) AS f FROM part) GROUP BY ALL), g AS (SELECT f, count(*) AS v FROM (SELECT unnest({_features(D.q(PART_QUERY))}) AS f) GROUP BY ALL),
dn AS (SELECT p_partkey, sqrt(sum(w * w)) AS dn FROM f GROUP BY 1), x AS (SELECT p_partkey, round(sum(w * v) / any_value(dn) / (SELECT sqrt(sum(v * v)) FROM g), 4) AS semantic FROM f JOIN g USING (f) JOIN dn USING (p_partkey) GROUP BY 1)
SELECT p_partkey, semantic FROM x ORDER BY semantic DESC, p_partkey LIMIT 20""")
def ngram_cosine_topk(spark, sf):
    one = spark.createDataFrame([(0, PART_QUERY)], "query_id int, text string")
    return engine.cosine(table(spark, sf, "part"), "p_partkey", "p_name", one, "text").orderBy(F.desc("semantic"), "p_partkey").limit(20).select("p_partkey", "semantic")


@query("SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 4) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) o ORDER BY cosine DESC, vec_id LIMIT 10")
def dense_cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    one = [float(x) for x in e.orderBy("vec_id").first()["v"]]
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    o = F.array(*map(F.lit, one))
    return e.select("vec_id", F.round(dot(F.col("v"), o) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(o, o)), 4).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)


@query(f"WITH t AS (SELECT p_partkey, {D.match('p_name')} AS t FROM part) SELECT p_partkey, greatest(CASE WHEN contains(t, 'small bolt') THEN 1.0 ELSE 0.0 END, CASE WHEN t = 'small bolt' THEN 3.0 ELSE 0.0 END, CASE WHEN replace(t, ' ', '') = 'smallbolt' THEN 2.6 ELSE 0.0 END)::DOUBLE AS phrase FROM t")
def phrase_score(spark, sf):
    t = X.match_norm(F.col("p_name"))
    d = table(spark, sf, "part").select("p_partkey", t.alias("title_norm"), t.alias("body_norm"), F.lit("small bolt").alias("normalized"), F.lit("smallbolt").alias("compacted"))
    return d.select("p_partkey", engine.phrase().alias("phrase"))


SIGNALS = "SELECT vec_id, " + ", ".join(f"abs(embedding[{i + 1}]::DOUBLE) * {m} AS {c}" for i, (c, m) in enumerate([("lexical", 3), ("title_bm25", 0), ("fuzzy", 3), ("semantic", 2), ("phonetic", 2), ("popularity", 1), ("recency", 1), ("language_boost", 0)])) + ", CASE WHEN vec_id % 7 = 0 THEN 3.0 ELSE 0.0 END::DOUBLE AS phrase, (vec_id % 3)::INT AS matched FROM embeddings"
TOTAL = "(lexical * 0.32 + title_bm25 * 0.18 + fuzzy * 0.14 + semantic * 0.18 + phrase * 0.08 + phonetic * 0.04 + popularity * 0.03 + recency * 0.01 + language_boost * 0.06)"


def _signals(spark, sf):
    e = table(spark, sf, "embeddings")
    cols = [("lexical", 3), ("title_bm25", 0), ("fuzzy", 3), ("semantic", 2), ("phonetic", 2), ("popularity", 1), ("recency", 1), ("language_boost", 0)]
    return e.select("vec_id", *[(F.abs(F.col("embedding")[i].cast("double")) * m).alias(c) for i, (c, m) in enumerate(cols)], F.when(F.col("vec_id") % 7 == 0, 3.0).otherwise(0.0).alias("phrase"), (F.col("vec_id") % 3).cast("int").alias("matched")).withColumn("total", rank.total())


@query(f"WITH s AS ({SIGNALS}), t AS (SELECT *, {TOTAL} AS total FROM s) SELECT vec_id, round(total, 4) AS total, round(CASE WHEN phrase >= 1.2 THEN least(0.99, 0.7 + total / 4.0) WHEN fuzzy >= 0.9 AND semantic >= 0.3 THEN least(0.95, 0.62 + total / 4.5) ELSE greatest(0.15, least(0.9, 0.35 + total / 5.0)) END, 6) AS confidence FROM t")
def hybrid_score(spark, sf):
    return _signals(spark, sf).select("vec_id", F.round("total", 4).alias("total"), F.round(rank.raw_confidence(), 6).alias("confidence"))


@query(f"""WITH s AS ({SIGNALS}), t AS (SELECT *, {TOTAL} AS total FROM s) SELECT vec_id, (total > 0.35 AND (matched >= 2 OR title_bm25 > 0 OR phrase > 0 OR fuzzy >= 0.72 OR semantic >= 0.32 OR phonetic >= 0.5))
 OR fuzzy >= 0.78 OR (semantic >= 0.28 AND (matched > 0 OR fuzzy >= 0.55 OR phonetic >= 0.34 OR title_bm25 > 0)) OR phrase > 0 AS admitted FROM t""")
def candidate_admission(spark, sf):
    return _signals(spark, sf).select("vec_id", rank.admitted().alias("admitted"))


@query()
def hybrid_search(spark, sf):
    """Every distinct part name with a letter lost, against the stored index of all parts."""
    c = of_parts(spark, sf).withColumn("body", F.concat_ws(" ", "title", "category", "instructor")).withColumn("popularity", F.col("popularity") / 10_000)
    asked = table(spark, sf, "part").groupBy(F.regexp_replace("p_name", "([a-z]{3})[a-z]", "$1").alias("query")).agg(F.min("p_partkey").alias("query_id"))
    return engine.search(StoredIndex.build(c), asked)


# Fuzzy matches and repairs


def _titles(spark, sf) -> DataFrame:
    return index.title_choices(table(spark, sf, "part"), F.col("p_name"))


@query()
def fuzzy_ratio_topk(spark, sf):
    one = spark.createDataFrame([(0, "smal bolt")], "query_id int, query string")
    return repair.best_matches(one, _titles(spark, sf), 5, 0.7, S.indel_ratio).select("query_id", "choice", "score", "rank")


@query()
def fuzzy_partial_topk(spark, sf):
    one = spark.createDataFrame([(0, "bolt")], "query_id int, query string")
    return repair.best_matches(one, _titles(spark, sf), 5, 0.7, S.partial_ratio).select("query_id", "choice", "score", "rank")


@query()
def fuzzy_token_set(spark, sf):
    one = spark.createDataFrame([(0, "bolt small thing")], "query_id int, query string")
    return repair.best_matches(one, _titles(spark, sf), 5, 0.6).select("query_id", "choice", "score", "rank")


@query()
def repair_tokens(spark, sf):
    noisy = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.regexp_replace(X.match_norm(F.col("p_name")), "([a-z]{4})[a-z]", "$1").alias("query"))
    return repair.token_repairs(noisy, index.vocabulary(table(spark, sf, "part"), F.col("p_name")))


@query()
def repair_whole(spark, sf):
    """Every part name with a letter lost."""
    noisy = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.regexp_replace(X.match_norm(F.col("p_name")), "([a-z]{4})[a-z]", "$1").alias("query"))
    return repair.whole_repairs(noisy, _titles(spark, sf)).select("query_id", "choice", "score", "rank")


@query()
def repair_spacing(spark, sf):
    joined = _titles(spark, sf).select(F.replace("choice", F.lit(" "), F.lit("")).alias("c"), "choice").groupBy("c").agg(F.min("choice").alias("original"))
    qs = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), X.compact(F.col("p_name")).alias("query"))
    got = repair.best_matches(qs, joined.select(F.col("c").alias("choice")), 3, 0.86, S.indel_ratio)
    return got.join(joined.select(F.col("c").alias("choice"), "original"), "choice").select("query_id", "original", "score", "rank")


@query()
def segment_compact(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", X.compact(F.col("p_name")).alias("query"))
    cut = repair.segmented(p.select("query").distinct(), index.vocabulary(table(spark, sf, "part"), F.col("p_name")), [*L.SEGMENTATION_HINTS, *L.STOPWORDS, *L.FILLERS])
    return p.join(cut, "query", "left").select("p_partkey", "segmented")


# Filters, sorts, facets, groups, pages

_FILTERS = {
    "filter_category": ({"category": "economy"}, f"{D.match('category')} = {D.match(D.q('economy'))}"), "filter_instructor": ({"instructor": "Brand#2"}, f"{D.match('instructor')} = {D.match(D.q('Brand#2'))}"),
    "filter_difficulty": ({"difficulty": "advanced"}, "difficulty = 'advanced'"), "filter_duration": ({"duration_max": 20}, "(duration_minutes IS NULL OR duration_minutes = 0 OR duration_minutes <= 20)"),
    "filter_certification": ({"certification": False}, "certification IS NOT DISTINCT FROM false"), "filter_active": ({}, "true"), "filter_language": ({"language": "ENGLISH"}, f"{D.match('language')} = 'english'"),
}
for _name, (_filters, _sql) in _FILTERS.items():
    QUERIES[_name] = lambda spark, sf, f=_filters: of_parts(spark, sf).where(results.passes(f)).select("course_id", "title", "duration_minutes")
    ORACLE[_name] = f"WITH {PARTS} SELECT course_id, title, duration_minutes FROM p WHERE {_sql} AND active"

_SORTS = {"relevance": "total DESC", "popularity": "popularity DESC, total DESC", "newest": "recency DESC, total DESC", "alphabetical": "lower(title)", "recommended": "total DESC, popularity DESC, recency DESC"}
for _name, _sql in _SORTS.items():
    QUERIES[f"sort_{_name}"] = lambda spark, sf, s=_name: results.ranked(of_parts(spark, sf).withColumn("total", F.round(F.col("recency") * 0.5, 1)), s).select("course_id", F.col("rank").cast("long").alias("rank"))
    ORACLE[f"sort_{_name}"] = f"WITH {PARTS}, t AS (SELECT *, round(recency * 0.5, 1) AS total FROM p) SELECT course_id, row_number() OVER (ORDER BY {_sql}, doc_seq)::BIGINT AS rank FROM t"


@query(f"WITH {PARTS} SELECT 'language' AS facet, {D.match('language')} AS value, count(*)::BIGINT AS n FROM p GROUP BY ALL UNION ALL SELECT 'topic', topic, count(*)::BIGINT FROM p GROUP BY ALL UNION ALL SELECT 'difficulty', difficulty, count(*)::BIGINT FROM p WHERE difficulty IS NOT NULL GROUP BY ALL")
def facets(spark, sf):
    return results.facets(of_parts(spark, sf))


@query(f"WITH {PARTS} SELECT group_id, course_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY popularity DESC, doc_seq) AS k FROM p) WHERE k = 1")
def group_dedup(spark, sf):
    return results.first_of_group(of_parts(spark, sf), "group_id", [F.desc("popularity"), F.asc("doc_seq")]).select("group_id", "course_id")


@query(f"WITH {PARTS} SELECT a.course_id, b.course_id AS variant_id FROM p a JOIN p b ON a.group_id = b.group_id AND a.topic = b.topic AND a.instructor = b.instructor AND a.course_id <> b.course_id AND b.active")
def group_variants(spark, sf):
    c = of_parts(spark, sf).withColumn("own", F.concat_ws("|", "group_id", "topic", "instructor"))
    return results.variants(c, "own", "course_id")


@query(f"WITH {PARTS}, r AS (SELECT course_id, row_number() OVER (ORDER BY popularity DESC, doc_seq) AS rank FROM p) SELECT course_id, rank::BIGINT AS rank FROM r WHERE rank BETWEEN 51 AND 75")
def paginate(spark, sf):
    hits = results.ranked(of_parts(spark, sf).withColumn("total", F.lit(0.0)), "popularity")
    return results.page(hits, page=1, size=100, cursor="3").select("course_id", F.col("rank").cast("long").alias("rank"))


def _mark(e: str, w: str) -> str:
    return f"replace(replace({e}, '{w}', '<em>{w}</em>'), '{w.title()}', '<em>{w.title()}</em>')"


@query(f"SELECT p_partkey, {_mark(_mark('p_name', 'small'), 'bolt')} AS marked FROM part")
def highlight(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.highlight(F.col("p_name"), X.strings(["bolt", "small", "of", "bolt"])).alias("marked"))


@query(f"SELECT p_partkey, array_to_string(list_concat({D.items(L.GUIDANCE)}, [p_name, p_brand]), '|') AS guidance FROM part")
def no_results_guidance(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(results.guidance(F.array("p_name", "p_brand", "p_type")), "|").alias("guidance"))


@query(f"SELECT DISTINCT p_name AS text, 0.88::DOUBLE AS confidence FROM part WHERE contains({D.match('p_name')}, 'small')")
def suggest_titles(spark, sf):
    return table(spark, sf, "part").where(X.match_norm(F.col("p_name")).contains("small")).select(F.col("p_name").alias("text"), F.lit(0.88).alias("confidence")).distinct()


@query(f"SELECT DISTINCT term AS text, 0.74::DOUBLE AS confidence FROM (SELECT unnest([p_name, p_type, p_brand]) AS term FROM part) WHERE contains({D.match('term')}, 'st')")
def suggest_related(spark, sf):
    terms = table(spark, sf, "part").select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("text")).distinct()
    return terms.where(X.match_norm(F.col("text")).contains("st")).select("text", F.lit(0.74).alias("confidence"))


# Query log and guards


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 20")
def analytics_recent(spark, sf):
    return analytics.latest(table(spark, sf, "events"), 20, "event_id").select("event_id", "event_type", "value")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def analytics_top_queries(spark, sf):
    return analytics.popularity(table(spark, sf, "events"), "event_type")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 GROUP BY event_type")
def analytics_zero_results(spark, sf):
    e = table(spark, sf, "events").withColumn("result_count", F.get_json_object("props", "$.k").cast("int") % 10)
    return e.where("result_count = 0").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT round(coalesce(avg(value), 0.0), 2) AS mean_latency, count(*)::BIGINT AS n FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 500)")
def analytics_avg_latency_500(spark, sf):
    return analytics.mean_of_latest(table(spark, sf, "events"), "value", "event_id")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS i FROM events), r AS (
  SELECT event_id, user_id, i, true AS allowed, 0::BIGINT AS retry_after, [t] AS kept FROM e WHERE i = 1
  UNION ALL SELECT event_id, user_id, i, len(k) < 2, CASE WHEN len(k) < 2 THEN 0 ELSE greatest(1, trunc(k[1] + 86400 - t)) END::BIGINT, CASE WHEN len(k) < 2 THEN list_append(k, t) ELSE k END
  FROM (SELECT e.*, list_filter(r.kept, lambda x: x >= e.t - 86400) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) n
) SELECT event_id, user_id AS key, allowed, retry_after::INTEGER AS retry_after FROM r""")
def rate_limit_sequential(spark, sf):
    return analytics.allowed("user_id", "ts", table(spark, sf, "events"), limit=2, window=86_400)


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::BIGINT AS in_window FROM events")
def rate_limit_window_upper_bound(spark, sf):
    return analytics.requests_in_window(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 86_400).select("event_id", "user_id", "in_window")


# Evaluation


def _variant(tag: str, text):
    return F.struct(F.lit(tag).alias("tag"), text.alias("variant"))


@query("""WITH b AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark)
SELECT item_id, 'extra_spaces' AS tag, CASE WHEN len(w) < 2 THEN text ELSE '   ' || array_to_string(w, '   ') || '   ' END AS variant FROM b UNION ALL SELECT item_id, 'punctuation', '!! ' || text || ' ??' FROM b
UNION ALL SELECT item_id, 'nlp', 'show me a course about ' || text FROM b UNION ALL SELECT item_id, 'no_space', array_to_string(w, '') FROM b WHERE len(w) > 1 AND NOT regexp_matches(text, '[^\\x00-\\x7F]')
UNION ALL SELECT item_id, 'uppercase', upper(text) FROM b WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')""")
def benchmark_variants(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("w", F.split("text", " ")).withColumn("ascii", ~F.col("text").rlike("[^\\x00-\\x7F]"))
    v = F.array(
        _variant("extra_spaces", F.when(F.size("w") < 2, F.col("text")).otherwise(F.concat(F.lit("   "), F.array_join("w", "   "), F.lit("   ")))), _variant("punctuation", F.concat(F.lit("!! "), "text", F.lit(" ??"))),
        _variant("nlp", F.concat(F.lit("show me a course about "), "text")), _variant("no_space", F.when(F.col("ascii") & (F.size("w") > 1), F.array_join("w", ""))), _variant("uppercase", F.when(F.col("ascii"), F.upper("text"))),
    )
    return b.select("item_id", F.explode(v).alias("v")).select("item_id", "v.tag", "v.variant").where("variant is not null")


_BEST = _bm25_sql(_MANY, "body").replace("SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 10", "SELECT language AS tag, count(*)::BIGINT AS hits, sum((rank = 1)::INT)::BIGINT AS top1 FROM r JOIN d USING (doc_id) WHERE rank <= 3 GROUP BY language")


def _by_tag(spark, sf, best):
    best = best.where("rank <= 3").join(of_documents(spark, sf).select("doc_id", F.col("language").alias("tag")), "doc_id")
    return best.groupBy("tag").agg(F.count("*").alias("hits"), F.sum((F.col("rank") == 1).cast("int")).alias("top1"))


@query(_BEST)
def eval_topk_by_tag(spark, sf):
    return _by_tag(spark, sf, bm25_batch_queries(spark, sf))
