"""Search quality: variants of seed queries, expected against found groups, totals and counts by tag."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur import lexicon as L
from larkspur.operators import corrections
from larkspur.plans import engine
from larkspur.sources.store import StoredIndex, materialised, write_report

QUERY_SET = "query string, expected_group_id string, expected_no_results boolean, tags array<string>, preferred_language string"


def variants(text: str = "query") -> "F.Column":
    """An array of (tag, variant); those that a text doesn't have are null."""
    t = F.col(text)
    w = F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")
    ascii_ = ~t.rlike(r"[^\x00-\x7F]")
    one = lambda tag, v: F.struct(F.lit(tag).alias("tag"), v.alias("variant"))
    return F.array(
        one("generated_extra_spaces", F.when(F.size(w) < 2, t).otherwise(F.concat(F.lit("   "), F.array_join(w, "   "), F.lit("   ")))), one("generated_punctuation", F.concat(F.lit("!! "), t, F.lit(" ??"))),
        one("generated_nlp", F.concat(F.lit("show me a course about "), t)), one("generated_uppercase", F.when(ascii_, F.upper(t))), one("generated_no_space", F.when(ascii_ & (F.size(w) > 1), F.array_join(w, ""))),
    )


def generated(seeds: DataFrame, negatives: list[str] | None = None) -> DataFrame:
    """The seeds (QUERY_SET, with ``at`` for their order), their variants and the negative queries; of equal ones the first."""
    none = F.lit(None).cast("string")
    own = seeds.select("at", F.lit(0).alias("k"), "query", "expected_group_id", F.coalesce("expected_no_results", F.lit(False)).alias("expected_no_results"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "preferred_language")
    made = own.select("*", F.posexplode(variants()).alias("p", "v")).where("v.variant is not null and v.variant <> ''")
    made = made.select("at", (F.col("p") + 1).alias("k"), F.col("v.variant").alias("query"), "expected_group_id", "expected_no_results", F.array_distinct(F.concat("tags", F.array("v.tag"))).alias("tags"), "preferred_language")
    spark = seeds.sparkSession
    rest = spark.createDataFrame([(i + (1 << 40), q) for i, q in enumerate(negatives or L.NEGATIVE_QUERIES)], "at long, query string")
    rest = rest.select("at", F.lit(0).alias("k"), "query", none.alias("expected_group_id"), F.lit(True).alias("expected_no_results"), F.array(F.lit("negative_query")).alias("tags"), none.alias("preferred_language"))
    every = own.unionByName(made).unionByName(rest)
    w = Window.partitionBy("query", "expected_group_id", "expected_no_results").orderBy("at", "k")
    return every.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def write_query_set(queries: DataFrame, path: str) -> None:
    queries.orderBy("at", "k").drop("at", "k").coalesce(1).write.mode("overwrite").json(path)


def judged(index: StoredIndex, queries: DataFrame) -> DataFrame:
    """queries with found (the first groups), top1 and top3."""
    q = queries.withColumn("query_id", F.xxhash64("query", "expected_group_id", "expected_no_results"))
    states = materialised(corrections.understood(q.select("query_id", "query", "preferred_language"), index.choices(), index.table("vocabulary")))
    hits = engine.ordered(engine.retrieved(index, states)).where("rank <= 3").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "group_id"))), lambda x: x["group_id"]).alias("found"))
    out = q.join(hits, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    nothing = F.size("found") == 0
    return out.withColumns({
        "top1": F.when(F.col("expected_no_results"), nothing).otherwise(F.coalesce(F.get("found", F.lit(0)) == F.col("expected_group_id"), F.lit(False))),
        "top3": F.when(F.col("expected_no_results"), nothing).otherwise(F.coalesce(F.array_contains("found", F.col("expected_group_id")), F.lit(False))),
    }).drop("query_id")


def totals(results: DataFrame) -> DataFrame:
    positive, n = ~F.col("expected_no_results"), lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return results.agg(n(positive).alias("positive_total"), n(~positive).alias("negative_total"), n(positive & F.col("top1")).alias("top1_hits"), n(positive & F.col("top3")).alias("top3_hits"), n(~positive & F.col("top1")).alias("negative_passes"))


def by_tag(results: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("long"))
    return results.select(F.explode("tags").alias("tag"), "top1", "top3").groupBy("tag").agg(F.count("*").alias("count"), n("top1").alias("top1"), n("top3").alias("top3"))


def report(index: StoredIndex, queries: DataFrame, path: str | None = None) -> dict:
    """Totals, counts by tag and failures of a query set; written as JSON if a path is given."""
    r = materialised(judged(index, queries))
    failed = r.where(~F.col("top3")).select("query", F.coalesce("expected_group_id", F.lit("NO_RESULTS")).alias("expected"), F.col("found").alias("got")).collect()
    out = totals(r).first().asDict() | {"generated_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
    out |= {"per_tag": {t["tag"]: {k: t[k] for k in ("count", "top1", "top3")} for t in by_tag(r).collect()}, "failures": [f.asDict() for f in failed]}
    if path:
        write_report(out, index.spark, path)
    return out
