"""What a query is taken to mean: repairs, the correction decision, the query searched for, its terms and intent.

All for a batch of queries at once; choices and vocabulary are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur import lexicon as L
from larkspur.functions import similarity as S
from larkspur.functions import text as X
from larkspur.operators import repair
from larkspur.operators.prepare import forms
from larkspur.settings import SETTINGS
from larkspur.sources.store import materialised

#: The order of repairs of equal confidence.
SOURCES = ["spacing_repair", "token_repair", "title_fuzzy_repair", "compact_title_repair"]


def bare(c) -> "F.Column":
    return F.replace(c, F.lit(" "), F.lit(""))


def repairs(queries: DataFrame, choices: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, repairs: the repairs of each query (text, confidence, source), best first, each text once."""
    compact = choices.groupBy(bare("choice").alias("c")).agg(F.min("choice").alias("first"), F.max("choice").alias("last"))
    q = queries.select("query_id", "query", bare("query").alias("bare"))
    asked = q.select("query_id", F.col("bare").alias("query"))
    near = repair.best_matches(asked, compact.select(F.col("c").alias("choice")), 3, 0.74, S.indel_ratio).drop("query").withColumnRenamed("choice", "c").join(compact, "c").join(q.drop("bare"), "query_id")
    spacing = near.where("score >= 0.86").select("query_id", "query", F.col("first").alias("text"), "score", "rank", F.lit(SOURCES[0]).alias("source"))
    long = ~F.col("query").contains(" ") & (F.length("query") >= 10)
    title = near.where((F.col("score") >= 0.86) | long).select("query_id", "query", F.col("last").alias("text"), "score", "rank", F.lit(SOURCES[3]).alias("source"))
    whole = repair.best_matches(q, choices, 3, 0.82).select("query_id", "query", F.col("choice").alias("text"), "score", "rank", F.lit(SOURCES[2]).alias("source"))
    token = repair.token_repairs(q, vocabulary).join(q, "query_id").select("query_id", "query", F.col("repaired").alias("text"), F.col("confidence").alias("score"), F.lit(1).alias("rank"), F.lit(SOURCES[1]).alias("source"))
    every = spacing.unionByName(token).unionByName(whole.where("text <> query")).unionByName(title.where("text <> query")).where((F.col("source") != SOURCES[0]) | (F.col("text") != F.col("query")))
    order = [F.desc("score"), F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")), F.asc("rank")]
    once = every.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "text").orderBy(*order))).where("k = 1")
    placed = once.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return placed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text", F.col("score").alias("confidence"), "source"))), lambda x: F.struct(x["text"], x["confidence"], x["source"])).alias("repairs"))


def understood(queries: DataFrame, choices: DataFrame, vocabulary: DataFrame, filters: dict | None = None) -> DataFrame:
    """The state of each query (query_id, query and, if given, preferred_language).

    Adds normalized, segmented, repairs, corrected, did_you_mean, search_instead_for, alternates, retrieval, tokens,
    query_terms, languages (preferences), mixed, topics, difficulty, goal, summary and semantic_query.
    """
    filters = filters or {}
    if "preferred_language" not in queries.columns:
        queries = queries.withColumn("preferred_language", F.lit(None).cast("string"))
    q = queries.withColumn("plain", X.unicode_normalized(F.col("query"))).withColumn("filled", X.remove_fillers(F.col("plain")))
    # Each text's words are made once and cut off from the plan, which refers to them many times.
    q = materialised(q.withColumns({"normalized": X.match_norm(X.transliterated(F.col("filled"))), "first_words": X.tokens(F.col("filled"), False), "plain_norm": X.match_norm(F.col("plain"))})).withColumn("words", X.split_words(F.col("plain_norm")))
    asked = q.select(F.col("normalized").alias("query")).distinct()
    cut = repair.segmented(asked.where(~F.col("query").contains(" ") & (F.length("query") >= 12) & ~F.col("query").rlike(r"[^\x00-\x7F]")), vocabulary, [*L.SEGMENTATION_HINTS, *L.STOPWORDS, *L.FILLERS])
    q = q.join(cut.withColumnRenamed("query", "normalized"), "normalized", "left").withColumn("input", F.coalesce("segmented", "normalized"))
    found = repairs(q.select(F.col("input").alias("query_id"), F.col("input").alias("query")).distinct(), choices, vocabulary).withColumnRenamed("query_id", "input")
    q = q.join(found, "input", "left")
    known = choices.select(bare("choice").alias("compact_choice"), F.lit(True).alias("already")).distinct()
    q = q.withColumn("compacted", bare("input")).join(known, F.col("compacted") == F.col("compact_choice"), "left").withColumn("already", F.coalesce("already", F.lit(False)))
    top = F.get("repairs", F.lit(0))
    q = q.withColumn("corrected", F.when((top["confidence"] >= SETTINGS.autocorrect) & ~F.col("already"), top["text"]))
    q = q.withColumn("retrieval", F.coalesce("corrected", F.when(F.col("already"), top["text"]), "segmented", "normalized"))
    q = q.withColumn("near", S.indel_ratio("normalized", "corrected"))
    q = q.withColumns({
        "did_you_mean": F.when(F.col("near") < SETTINGS.did_you_mean, F.col("corrected")), "search_instead_for": F.when(F.col("corrected").isNotNull() & (top["confidence"] >= SETTINGS.show_results), F.col("query")),
        "alternates": F.coalesce(F.transform(F.slice("repairs", 2, 3), lambda x: x["text"]), F.array().cast("array<string>")), "tokens": X.tokens(F.col("retrieval"), False),
    })
    other = forms(q.select("plain").distinct(), "plain").groupBy("plain").agg(F.array_join(F.array_sort(F.collect_set("form")), " ").alias("forms"))
    q = q.join(other, "plain", "left")
    q = q.withColumn("asked", X.requested_of(F.col("words"))).withColumn("expanded", F.array_distinct(F.concat(X.synonyms(F.col("tokens")), X.tokens(F.coalesce("forms", F.lit("")), False))))
    own = F.filter(F.array(X.match_norm(F.col("preferred_language"))), lambda x: x != "")
    asked_for = F.array(F.lit(str(filters["language"]))) if filters.get("language") else F.array().cast("array<string>")
    q = q.withColumns({
        "query_terms": X.retrieval_terms(F.array_distinct(F.concat("tokens", "expanded"))), "topics": X.topics(F.col("expanded")), "difficulty": X.difficulty_of(F.col("words")), "goal": X.goal_of(F.col("plain_norm")), "mixed": X.mixed_of(F.col("plain"), F.col("asked")),
        "languages": F.array_distinct(F.concat("asked", X.languages_of(F.col("plain"), F.col("asked")), own, asked_for)),
    })
    q = q.withColumn("summary", X.summary(F.col("first_words"), F.col("topics"), F.col("difficulty"), F.col("languages")))
    q = q.withColumn("semantic_query", F.coalesce("corrected", F.when(F.col("summary") != "", F.col("summary")), "normalized"))
    if filters.get("difficulty"):
        q = q.withColumn("difficulty", F.coalesce("difficulty", F.lit(str(filters["difficulty"]).strip())))
    return q.drop("input", "plain", "filled", "plain_norm", "first_words", "words", "asked", "compact_choice", "near", "forms")
