"""Courses as they are searched: normalised names, generated transliterations, texts and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur import lexicon as L
from larkspur.functions import text as X

LISTS = ["aliases", "synonyms", "transliterations", "tags", "available_languages", "levels"]
TEXTS = ["body", "instructor", "language", "category", "topic", "competency_name", "updated_on", "difficulty"]


def completed(catalogue: DataFrame) -> DataFrame:
    """The catalogue with every column that is searched or shown; what a table lacks is empty.

    A loaded file's description, popularity_score and recency_score are called body, popularity and recency here.
    """
    none, have = F.array().cast("array<string>"), set(catalogue.columns)
    given = lambda x, other: F.col(x) if x in have else F.col(other) if other in have else F.lit(None)
    return catalogue.select(
        F.col("course_id"), F.coalesce(given("group_id", "course_id").cast("string"), F.col("course_id").cast("string")).alias("group_id"), F.col("doc_seq"), F.col("title"),
        *[F.coalesce(F.col(x), none).alias(x) if x in have else none.alias(x) for x in LISTS],
        *[given(x, "description" if x == "body" else "").cast("string").alias(x) for x in TEXTS],
        given("duration_minutes", "").cast("int").alias("duration_minutes"), given("certification", "").cast("boolean").alias("certification"),
        *[F.coalesce(given(x, f"{x}_score").cast("double"), F.lit(0.0)).alias(x) for x in ("popularity", "recency")],
        F.coalesce(given("active", "").cast("boolean"), F.lit(True)).alias("active"), given("metadata", "").cast("map<string,string>").alias("metadata"),
    )


def romanisation_pairs(spark) -> DataFrame:
    """(a, b): a phrase and another way to write it, both ways; as many rows as the fixed map has."""
    rows = [(X.plain_match_norm(k), X.plain_match_norm(x)) for k, v in L.ROMANIZED.items() for x in v]
    return spark.createDataFrame(rows + [(b, a) for a, b in rows], "a string, b string")


def forms(texts: DataFrame, text: str) -> DataFrame:
    """texts (distinct) with norm and form, a row for each form by the romanisation map, the norm itself included."""
    spaced = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    base = texts.withColumn("norm", X.match_norm(X.unicode_normalized(F.col(text))))
    found = base.join(F.broadcast(romanisation_pairs(texts.sparkSession)), spaced(F.col("norm")).contains(spaced(F.col("a")))).select(*base.columns, F.col("b").alias("form"))
    return found.unionByName(base.withColumn("form", F.col("norm"))).where("form <> ''").distinct()


def prepared(catalogue: DataFrame) -> DataFrame:
    """completed() with title_norm, body_norm, names (normalised aliases), transliterations (given and generated),
    suggestion_terms, semantic_text, title_terms and all_terms."""
    none = F.array().cast("array<string>")
    c = completed(catalogue)
    named = c.select("course_id", F.posexplode(F.concat(F.array("title"), "aliases", F.array(F.coalesce("competency_name", F.lit(""))))).alias("pos", "name"), F.size("aliases").alias("n"))
    known = forms(named.select("name").distinct(), "name").groupBy("name").agg(F.first("norm").alias("norm"), F.collect_set("form").alias("forms"))
    at = F.col("pos").between(1, F.col("n"))
    made = named.join(known, "name").groupBy("course_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("forms")))).alias("made"), F.transform(F.array_sort(F.collect_list(F.when(at, F.struct("pos", "norm")))), lambda x: x["norm"]).alias("names")
    )
    c = c.join(made.withColumnRenamed("course_id", "cid"), F.col("course_id") == F.col("cid"), "left").drop("cid")
    c = c.withColumns({"transliterations": F.array_distinct(F.concat("transliterations", F.coalesce("made", none))), "names": F.array_distinct(F.coalesce("names", none))}).drop("made")
    more = ["competency_name", F.array_join("levels", " "), "updated_on", F.array_join(F.coalesce(F.map_values("metadata"), none), " ")]
    lists = {x: F.array_join(x, " ") for x in LISTS}
    everything = F.concat_ws(" ", "title", lists["aliases"], lists["synonyms"], lists["transliterations"], "body", lists["tags"], "instructor", "topic", "category", "language", *more)
    semantic = F.concat_ws(" ", "title", "body", lists["tags"], lists["aliases"], lists["synonyms"], lists["transliterations"], "topic", "language", *more)
    shown = F.filter(F.array_distinct(F.concat(F.array("title"), "aliases", "tags", F.array("topic", "instructor", "language", "competency_name"), "levels")), lambda x: x.isNotNull() & (x != ""))
    title = X.unicode_normalized(F.col("title"))
    return c.withColumns({
        "title_norm": X.match_norm(title), "body_norm": X.match_norm(X.unicode_normalized(F.col("body"))), "suggestion_terms": shown, "semantic_text": X.unicode_normalized(semantic),
        "title_terms": X.tokens(title, False), "all_terms": X.tokens(X.unicode_normalized(everything), False),
    })
