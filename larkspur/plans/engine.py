"""Search for a batch of queries over a stored index: nine signals, admission, order, pages, and the service's verbs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.errors import ServiceError
from larkspur.functions import similarity as S
from larkspur.functions import text as X
from larkspur.operators import analytics, corrections, rank, repair, results
from larkspur.operators import index as I
from larkspur.settings import SETTINGS
from larkspur.sources.catalogue import load_json
from larkspur.sources.store import StoredIndex, materialised

KEYS = ["query_id", "course_id"]
SCORES = ["lexical", "title_bm25", "semantic", "phonetic", "fuzzy", "phrase"]


def cosine(docs: DataFrame, id: str, text: str, queries: DataFrame, query: str) -> DataFrame:
    """query_id, id, semantic: cosine of feature counts; only pairs that share a feature exist.

    Texts are dealt by id once; counts and norms are made where they lie, so nothing that grows with the documents is joined or broadcast.
    """
    dealt = docs.where(F.col(id).isNotNull()).select(id, text).repartition(id)
    d = I.terms_of(dealt, X.features(F.col(text)), id).groupBy(id, F.col("term").alias("f")).agg(F.count("*").alias("w"))
    d = d.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id))))
    q = query_features(queries.select("query_id", F.col(query).alias("text")))
    few = I.few(q)
    return dots(d, id, few if few is not q else q.hint("merge")).select("query_id", id, F.round("semantic", 4).alias("semantic"))


def query_features(queries: DataFrame) -> DataFrame:
    """query_id, f, v (its count), qn (the query's norm)."""
    q = queries.select("query_id", F.explode(X.features(F.col("text"))).alias("f")).groupBy("query_id", "f").agg(F.count("*").alias("v"))
    return q.withColumn("qn", F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("query_id"))))


def cosine_of(features: DataFrame, id: str, queries: DataFrame) -> DataFrame:
    """The same from stored features (id, f, w, norm)."""
    return dots(features, id, query_features(queries))


def dots(features: DataFrame, id: str, q: DataFrame) -> DataFrame:
    return features.join(q, "f").groupBy("query_id", id).agg((F.sum(F.col("w") * F.col("v")) / F.first("norm") / F.first("qn")).alias("semantic"))


def phonetic(docs: DataFrame, id: str, text: str, terms: DataFrame) -> DataFrame:
    """query_id, id, phonetic: the share of query terms (repeated ones too) whose code the document has.

    Codes are made once for each distinct term of a document; only those that are asked for are shuffled.
    """
    asked = terms.withColumn("code", X.soundex_ref(F.col("term")))
    wanted = I.few(asked.where("code <> ''").select("code").distinct())
    # The distinct codes of a document, as an array, are made before they are rows: once, not for each use in the join.
    codes = I.terms_of(docs, F.array_distinct(F.transform(F.array_distinct(X.tokens(F.col(text))), X.soundex_ref)), id).withColumnRenamed("term", "code").join(wanted, "code", "left_semi").distinct()
    n = terms.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = asked.where("code <> ''").join(codes, "code").groupBy("query_id", id).agg(F.count("*").alias("hits"))
    return hits.join(n, "query_id").select("query_id", id, F.round(F.col("hits") / F.greatest("n", F.lit(1)), 4).alias("phonetic"))


def matched(docs: DataFrame, id: str, text: str, terms: DataFrame) -> DataFrame:
    wanted = terms.distinct()
    each = I.terms_of(docs, F.array_distinct(X.tokens(F.col(text))), id)
    return each.join(I.few(wanted), "term").groupBy("query_id", id).agg(F.count("*").alias("matched"), F.array_sort(F.collect_list("term")).alias("matched_terms"))


def phrase() -> "F.Column":
    """Of title_norm, body_norm, normalized and compacted."""
    title, q = F.col("title_norm"), F.col("normalized")
    return F.greatest(F.when((q != "") & F.col("body_norm").contains(q), 1.0).otherwise(0.0), F.when(q == title, 3.0).otherwise(0.0), F.when((F.col("compacted") != "") & (F.col("compacted") == F.replace(title, F.lit(" "), F.lit(""))), 2.6).otherwise(0.0))


def by_terms(index: StoredIndex, q: DataFrame) -> DataFrame:
    """lexical, title_bm25, phonetic and matched_terms, from one join with the postings of the terms asked for."""
    asked = q.select("query_id", F.size("terms").alias("asked"), F.explode("terms").alias("wanted")).withColumn("code", X.soundex_ref(F.col("wanted")))
    known = index.table("terms")
    sounds = asked.where("code <> ''").join(known, "code").select("query_id", "asked", "wanted", "term", "df", F.lit(1).alias("sounds"))
    mute = asked.where("code = ''").join(known.drop("code"), F.col("wanted") == F.col("term")).select("query_id", "asked", "wanted", "term", "df", F.lit(0).alias("sounds"))
    hits = index.table("postings").where("tf > 0").join(sounds.unionByName(mute), "term")
    st, k1, b = index.stats(), SETTINGS.k1, SETTINGS.b
    same = F.col("term") == F.col("wanted")
    idf = F.log(1 + (F.lit(max(st["n"], 1)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = lambda tf, n, mean: idf * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.greatest(n, F.lit(1)) / F.lit(mean)))
    each = hits.groupBy(*KEYS, "wanted").agg(
        F.first("asked").alias("asked"), F.max("sounds").alias("sounds"), F.sum(F.when(same, part("tf", "all_len", st["all_avg"]))).alias("l"),
        F.sum(F.when(same & (F.col("title_tf") > 0), part("title_tf", "title_len", st["title_avg"]))).alias("t"), F.max(F.when(same, F.col("wanted"))).alias("m"),
    )
    return each.groupBy(*KEYS).agg(F.sum("l").alias("lexical"), F.sum("t").alias("title_bm25"), (F.sum("sounds") / F.greatest(F.first("asked"), F.lit(1))).alias("phonetic"), F.array_sort(F.collect_list("m")).alias("matched_terms"))


def by_phrase(index: StoredIndex, q: DataFrame) -> DataFrame:
    """phrase: 3.0 for a title or alias that equals the query, 2.6 and 2.4 without spaces, 1.0 inside the description."""
    asked = q.select("query_id", "text", F.replace("text", F.lit(" "), F.lit("")).alias("bare")).where("text <> ''")
    names = index.table("names")
    whole = names.join(asked, F.col("norm") == F.col("text")).select(*KEYS, F.lit(3.0).alias("phrase"))
    bare = names.join(asked, F.col("compact") == F.col("bare")).select(*KEYS, F.when(F.col("title"), 2.6).otherwise(2.4).alias("phrase"))
    inside = index.table("courses").select("course_id", "body_norm").join(asked, F.col("body_norm").contains(F.col("text"))).select(*KEYS, F.lit(1.0).alias("phrase"))
    return whole.unionByName(bare).unionByName(inside).groupBy(*KEYS).agg(F.max("phrase").alias("phrase"))


def by_likeness(names: DataFrame, q: DataFrame) -> DataFrame:
    """fuzzy: the best of seven similarities; every query of the batch meets every distinct title and alias once."""
    asked = q.select("query_id", "text", F.replace("text", F.lit(" "), F.lit("")).alias("bare")).where("text <> ''")
    once = names.select("norm", "compact", "title").distinct()
    pairs = once.crossJoin(asked)
    bare = (S.indel_ratio("bare", "compact"), S.partial_ratio("bare", "compact"))
    of_title = pairs.where("title").select("query_id", "norm", "title", F.greatest(S.indel_ratio("text", "norm"), S.partial_ratio("text", "norm"), *bare).alias("fuzzy"))
    of_name = pairs.where("not title").select("query_id", "norm", "title", F.greatest(S.token_set_ratio("text", "norm"), *bare).alias("fuzzy"))
    return names.join(of_title.unionByName(of_name).where("fuzzy > 0"), ["norm", "title"]).groupBy(*KEYS).agg(F.max("fuzzy").alias("fuzzy"))


def signals(index: StoredIndex, q: DataFrame) -> DataFrame:
    """query_id, course_id, the SCORES, matched_terms and matched; ``q`` has query_id, text, terms, semantic_query.

    Each signal comes as rows of its own; one aggregation brings them together.
    """
    parts = [
        by_terms(index, q), cosine_of(index.table("features"), "course_id", q.select("query_id", F.col("semantic_query").alias("text"))),
        by_phrase(index, q), by_likeness(index.table("names"), q),
    ]
    every = None
    for p in parts:
        row = p.select(*KEYS, *[F.col(x).cast("double") if x in p.columns else F.lit(None).cast("double").alias(x) for x in SCORES], F.col("matched_terms") if "matched_terms" in p.columns else F.lit(None).cast("array<string>").alias("matched_terms"))
        every = row if every is None else every.unionByName(row)
    out = every.groupBy(*KEYS).agg(*[F.coalesce(F.max(x), F.lit(0.0)).alias(x) for x in SCORES], F.coalesce(F.max("matched_terms"), F.array().cast("array<string>")).alias("matched_terms"))
    return out.withColumn("matched", F.size("matched_terms"))


def scored(index: StoredIndex, q: DataFrame, filters: dict) -> DataFrame:
    """Candidates that pass the filters: the course's columns, signals and total."""
    hits = signals(index, q).join(index.table("courses"), "course_id").where(results.passes(filters)).join(q.select("query_id", "languages"), "query_id")
    hits = hits.withColumn("language_boost", F.when(F.array_contains("languages", X.match_norm(F.col("language"))), 1.0).otherwise(0.0)).drop("languages")
    return hits.withColumn("total", rank.total())


def retrieved(index: StoredIndex, states: DataFrame, filters: dict | None = None) -> DataFrame:
    """The admitted candidates of each query; where there are none, those of its corrected text that score at all."""
    filters = filters or {}
    q = states.select("query_id", F.coalesce("corrected", "normalized").alias("text"), F.col("query_terms").alias("terms"), "semantic_query", "languages")
    first = materialised(scored(index, q, filters).where(rank.admitted()))
    again = states.where("corrected is not null and corrected <> normalized").join(first.select("query_id").distinct(), "query_id", "left_anti")
    again = again.select("query_id", F.col("corrected").alias("text"), X.tokens(F.col("corrected"), False).alias("terms"), F.col("corrected").alias("semantic_query"), "languages")
    return first.unionByName(scored(index, again, filters).where("total > 0")) if again.limit(1).count() else first


def ordered(hits: DataFrame, sort: str = "relevance") -> DataFrame:
    """One hit of each group, with its rank."""
    best = hits.withColumn("g", F.row_number().over(Window.partitionBy("query_id", "group_id").orderBy(*results.order(sort)))).where("g = 1").drop("g")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*results.order(sort))))


def shown(hits: DataFrame, states: DataFrame, index: StoredIndex, debug: bool = False) -> DataFrame:
    """Hits as a response has them: rounded scores, highlights, variants, metadata."""
    others = index.table("courses").where("active").select(F.col("group_id").alias("g"), F.col("course_id").alias("other"), F.struct("doc_seq", F.struct("course_id", "title", "language").alias("v")).alias("v"))
    pairs = hits.select("query_id", "course_id", "group_id").join(others, (F.col("group_id") == F.col("g")) & (F.col("course_id") != F.col("other")))
    own = pairs.groupBy("query_id", "course_id").agg(F.transform(F.array_sort(F.collect_list("v")), lambda x: x["v"]).alias("grouped_variants"))
    h = hits.join(own, KEYS, "left").join(states.select("query_id", "expanded"), "query_id")
    mark = lambda c: X.highlight(c, F.col("expanded"))
    more = F.map_from_arrays(F.array(F.lit("competency_name"), F.lit("levels"), F.lit("updated_on")), F.array("competency_name", F.to_json("levels"), "updated_on"))
    given = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("competency_name", "levels", "updated_on"))
    out = h.select(
        "query_id", "rank", "course_id", "group_id", "title", F.col("body").alias("description"), "instructor", "language", "available_languages", "category", "topic", "difficulty", "duration_minutes", "certification",
        F.map_concat(given, more).alias("metadata"), F.round("total", 4).alias("score"), F.round(rank.raw_confidence(), 4).alias("confidence"), "matched_terms", rank.explanations().alias("explanations"),
        F.struct(mark(F.col("title")).alias("title"), mark(F.coalesce("body", F.lit(""))).alias("description"), F.transform("tags", mark).alias("tags")).alias("highlights"),
        F.coalesce("grouped_variants", F.array().cast("array<struct<course_id:string,title:string,language:string>>")).alias("grouped_variants"),
        F.struct(*[F.round(x, 6).alias(x) for x in [*SCORES, "popularity", "recency", "language_boost", "total"]]).alias("debug"),
    )
    return out if debug else out.drop("debug")


def search(index: StoredIndex, queries: DataFrame, filters: dict | None = None, sort: str = "relevance", k: int = 10) -> DataFrame:
    """query_id, rank and the hit: course_id, title, total, confidence, explanations, matched terms; the first k of each query."""
    states = materialised(corrections.understood(queries, index.choices(), index.table("vocabulary"), filters))
    hits = ordered(retrieved(index, states, filters), sort).where(F.col("rank") <= max(1, min(k, SETTINGS.max_page_size)))
    return hits.select("query_id", "rank", "course_id", "title", F.round("total", 4).alias("total"), rank.confidence().alias("confidence"), F.array_join(rank.explanations(), "; ").alias("explanations"), F.array_join("matched_terms", " ").alias("matched_terms"))


class SearchEngine:
    """The verbs of the service over a catalogue table; the index is built when it is first asked for after a change."""

    def __init__(self, spark: SparkSession, catalogue: DataFrame, path: str | None = None, log: analytics.QueryLog | None = None) -> None:
        self.spark, self.catalogue, self.path, self.log = spark, catalogue, path, log
        self._index: StoredIndex | None = None
        self._built = 0

    def index(self) -> StoredIndex:
        if self._index is None:
            self._built += 1
            self._index = StoredIndex.build(self.catalogue, f"{self.path}/v{self._built}" if self.path else None)
        return self._index

    def checked(self, query: str) -> str:
        if not query or not query.strip():
            raise ServiceError("empty_query", "Search query must not be empty")
        if len(query) > SETTINGS.max_query_length:
            raise ServiceError("query_too_long", "Search query exceeded the maximum supported length", details={"max_query_length": SETTINGS.max_query_length})
        return query

    def one(self, query: str, preferred_language: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([(0, self.checked(query), preferred_language)], "query_id int, query string, preferred_language string")

    def search(self, query: str, preferred_language: str | None = None, **options) -> DataFrame:
        return search(self.index(), self.one(query, preferred_language), **options)

    def search_batch(self, queries: DataFrame, **options) -> DataFrame:
        return search(self.index(), queries, **options)

    def respond(self, query: str, preferred_language: str | None = None, filters: dict | None = None, sort: str = "relevance", page: int = 1, page_size: int = 10, cursor: str | None = None, debug: bool = False, route: str = "search") -> dict:
        """The whole response to one query; at most a page of rows comes to the driver."""
        began, index, filters = time.perf_counter(), self.index(), results.applied(filters or {})
        states = materialised(corrections.understood(self.one(query, preferred_language), index.choices(), index.table("vocabulary"), filters))
        s = states.first().asDict(recursive=True)
        hits = materialised(retrieved(index, states, filters))
        every = ordered(hits, sort)
        total = every.count()
        found = [r.asDict(recursive=True) for r in shown(results.page(every, page, page_size, cursor), states, index, debug).orderBy("rank").collect()]
        counts: dict[str, dict] = {}
        for r in results.facets(hits).collect():  # values of three columns among the admitted
            counts.setdefault(r["facet"], {})[r["value"]] = r["n"]
        took = (time.perf_counter() - began) * 1000
        if self.log:
            self.log.search(s["query"], s["normalized"], s["corrected"], len(found), took, route, {"filters_applied": filters, "detected_languages": sorted(s["languages"]), "sort": sort})
            if s["corrected"]:
                self.log.correction(s["query"], s["corrected"], route)
        intent = {"intent_type": "course_discovery", "topics": s["topics"], "specialties": s["topics"], "language_preferences": s["languages"], "difficulty": s["difficulty"], "educational_goal": s["goal"], "summary": s["summary"]}
        out = {
            "schema_version": SETTINGS.schema_version, "original_query": query, "normalized_query": s["normalized"], "corrected_query": s["corrected"], "did_you_mean": s["did_you_mean"], "search_instead_for": s["search_instead_for"],
            "detected_languages": sorted(set(s["languages"])), "extracted_search_intent": intent, "filters_applied": filters, "results": found, "grouped_suggestions": self.suggest(query, preferred_language, 5, states), "alternate_queries": s["alternates"],
            "no_results_guidance": None if found else results.no_results(s["corrected"] or s["normalized"], filters, s["alternates"]), "facets": counts, "pagination": results.pagination(total, results.page_number(page, cursor), page_size),
        }
        if debug:
            histogram = {w: s["tokens"].count(w) for w in s["tokens"]}
            out["debug_info"] = {"query_pipeline": {"repair_candidates": s["repairs"] or [], "retrieval_query": s["retrieval"], "token_histogram": histogram, "normalized_tokens": s["tokens"]}, "latency_ms": round(took, 2)}
        return out

    def suggestions(self, query: str, preferred_language: str | None = None, limit: int = 8, state: DataFrame | None = None) -> DataFrame:
        """section, position, text, type, confidence, metadata: six sections, each text once in any case, the most confident first."""
        index = self.index()
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        if state is None:
            state = materialised(corrections.understood(self.spark.createDataFrame([(0, query, preferred_language)], "query_id int, query string, preferred_language string"), index.choices(), index.table("vocabulary")))
        c, norm = index.table("courses"), F.lit(X.plain_match_norm(query))
        none = F.create_map().cast("map<string,string>")

        def best(column: str, section: int, name: str, kind: str, most: int) -> DataFrame:
            near = repair.best_matches(asked, c.select(F.col(column).alias("choice")).where("choice is not null").distinct(), most, 0.0)
            return near.select(F.lit(section).alias("s"), F.lit(name).alias("section"), F.col("choice").alias("text"), F.lit(kind).alias("type"), F.col("score").alias("confidence"), (F.col("rank") + 1_000_000_000).cast("long").alias("at"), none.alias("metadata"))

        row = lambda df, s, name, text, kind, confidence, at, meta: df.select(F.lit(s).alias("s"), F.lit(name).alias("section"), text.alias("text"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), at.cast("long").alias("at"), meta.alias("metadata"))
        parts = [row(state.where("did_you_mean is not null"), 0, "corrected_query", F.col("did_you_mean"), "did_you_mean", 0.93, F.lit(0), none)]
        parts.append(row(c.where((norm != "") & F.col("title_norm").contains(norm)), 1, "course_titles", F.col("title"), "course_title", 0.88, F.col("doc_seq"), F.create_map(F.lit("language"), F.col("language"), F.lit("course_id"), F.col("course_id").cast("string"))))
        parts += [best("title", 1, "course_titles", "course_title", limit), best("topic", 2, "topics", "topic", max(3, limit // 2)), best("instructor", 3, "instructors", "instructor", max(3, limit // 3))]
        related = c.select("doc_seq", F.posexplode("suggestion_terms").alias("pos", "term")).where((norm != "") & X.match_norm(F.col("term")).contains(norm))
        first = related.groupBy("term").agg(F.min(F.struct("doc_seq", "pos")).alias("at")).orderBy("at").limit(limit)
        parts.append(row(first, 4, "related_queries", F.col("term"), "related_query", 0.74, F.col("at.doc_seq") * 1000 + F.col("at.pos"), none))
        if preferred_language:
            parts.append(row(asked, 5, "language_aware", F.lit(f"{query} in {preferred_language}"), "language_aware", 0.71, F.lit(0), F.create_map(F.lit("preferred_language"), F.lit(preferred_language))))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        once = every.withColumn("k", F.row_number().over(Window.partitionBy("s", F.lower("text")).orderBy(F.desc("confidence"), "at"))).where("k = 1")
        placed = once.withColumn("position", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("confidence"), "at"))).where(F.col("position") <= limit)
        return placed.orderBy("s", "position").select("section", "position", "text", "type", "confidence", "metadata")

    def suggest(self, query: str, preferred_language: str | None = None, limit: int = 8, state: DataFrame | None = None) -> list[dict]:
        """The sections that have items, with at most ``limit`` each."""
        out: dict[str, list] = {}
        for r in self.suggestions(query, preferred_language, max(1, min(limit, 10)), state).collect():
            out.setdefault(r["section"], []).append({"text": r["text"], "type": r["type"], "confidence": r["confidence"], "metadata": r["metadata"]})
        return [{"section": k, "items": v} for k, v in out.items()]

    def suggest_logged(self, query: str, preferred_language: str | None = None, limit: int = 8) -> list[dict]:
        """suggest, with its number of items in the query log."""
        began = time.perf_counter()
        out = self.suggest(query, preferred_language, limit)
        if self.log:
            self.log.search(query, query, None, sum(len(g["items"]) for g in out), (time.perf_counter() - began) * 1000, "suggest", {"preferred_language": preferred_language, "sections": [g["section"] for g in out]})
        return out

    def voice(self, file_name: str, content_type: str, length: int, preferred_language: str | None = None, debug: bool = False) -> dict:
        """Search by a recording: its transcript, cleaned, is the query; what fails after the checks degrades the response."""
        analytics.check_audio(content_type, length)
        try:
            said = self.spark.createDataFrame([(file_name,)], "path string").select(analytics.mock_transcript(F.col("path")).alias("t")).first()["t"]
            if not said:
                raise ServiceError("stt_unavailable", "Voice transcript could not be derived", 503, {"filename": file_name})
            found = self.respond(said, preferred_language, debug=debug, route="voice_search")
            return {"schema_version": SETTINGS.schema_version, "transcript": said, "transcript_cleaned": said, "transcription_confidence": analytics.MOCK_CONFIDENCE, "degraded": False, "search_response": found, "metadata": {"filename": file_name}}
        except ServiceError as e:
            if self.log:
                self.log.search(file_name, None, None, 0, 0.0, "voice_search", {"reason": str(e), "filename": file_name, "content_type": content_type}, degraded=True)
            return {"schema_version": SETTINGS.schema_version, "degraded": True, "degradation_reason": str(e), "metadata": {"code": e.code, "filename": file_name}}

    def _changed(self, catalogue: DataFrame) -> None:
        self.catalogue, self._index = materialised(catalogue), None

    def upsert(self, batch: DataFrame) -> int:
        I.required(batch, "empty_index_request")
        self._changed(I.upsert(self.catalogue, batch, "course_id", "doc_seq"))
        return batch.count()

    def delete(self, ids: DataFrame) -> int:
        I.required(ids, "empty_delete_request")
        n = self.catalogue.join(ids.select("course_id").distinct(), "course_id", "left_semi").count()
        self._changed(I.delete(self.catalogue, ids, "course_id"))
        return n

    def reindex(self, batch: DataFrame | None = None, sample: str | None = None) -> int:
        """Deletes everything, then loads a file of courses and indexes a batch, as far as they are given."""
        n, self.catalogue = 0, self.catalogue.limit(0)
        for part in ([load_json(self.spark, sample)] if sample else []) + ([batch] if batch is not None and not batch.isEmpty() else []):
            n += part.count()
            empty = self.catalogue.isEmpty()
            self.catalogue = I.upsert(part.limit(0) if empty else self.catalogue, part, "course_id", "doc_seq")
        self._changed(self.catalogue)
        return n

    def health(self, kind: str = "health") -> dict:
        """status: healthy, ready or warming, or live; and the dependencies' states."""
        backend = self.index().health()
        n = backend["details"].get("document_count", 0)
        status = {"health": "healthy", "ready": "ready" if n else "warming", "live": "live"}[kind]
        parts = [{"name": "search_backend", **backend}, {"name": "semantic_encoder", "status": "up", "details": {"model_loaded": False}}]
        return {"schema_version": SETTINGS.schema_version, "status": status, "dependencies": parts + ([{"name": "analytics_store", **self.log.health()}] if self.log else [])}

    def status(self) -> dict:
        return {"status": "ok", "documents": self.catalogue.count()}
