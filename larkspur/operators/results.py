"""Filters, sorts, facets, one hit per group, variants, pages and guidance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur import lexicon as L
from larkspur.functions import text as X
from larkspur.settings import SETTINGS
from larkspur.sources.store import materialised

TEXT_FILTERS = ["language", "category", "topic", "instructor", "difficulty"]


def passes(filters: dict) -> Column:
    """The filter a request asks for. 0 minutes asks for nothing; a null certification is not False."""
    out = F.lit(True)
    for name in TEXT_FILTERS:
        if filters.get(name):
            out = out & (X.match_norm(F.coalesce(F.col(name), F.lit(""))) == X.match_norm(F.lit(filters[name])))
    if filters.get("duration_max"):
        d = F.col("duration_minutes")
        out = out & F.coalesce((d == 0) | (d <= filters["duration_max"]), F.lit(True))
    if filters.get("certification") is not None:
        out = out & F.col("certification").eqNullSafe(F.lit(filters["certification"]))
    return out & F.col("active")


def applied(filters: dict) -> dict:
    return {k: v for k, v in filters.items() if v not in (None, "", [])}


def order(sort: str, seq: str = "doc_seq") -> list[Column]:
    keys = {
        "relevance": [F.desc("total")], "popularity": [F.desc("popularity"), F.desc("total")], "newest": [F.desc("recency"), F.desc("total")],
        "alphabetical": [F.asc(F.lower("title"))], "recommended": [F.desc("total"), F.desc("popularity"), F.desc("recency")],
    }
    return [*keys[sort], F.asc(seq)]


def ranked(hits: DataFrame, sort: str, seq: str = "doc_seq", by: list[str] | None = None) -> DataFrame:
    """hits with rank from 1. Without ``by`` the order is global: rows are dealt by range, and only per-partition
    counts (one row each) meet to give each partition its first number."""
    if by:
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order(sort, seq))))
    # Range partitions are written down once, so their numbers can't differ between the count and the numbering.
    part = materialised(hits.repartitionByRange(*order(sort, seq)).withColumn("p", F.spark_partition_id()))
    before = part.groupBy("p").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("p")) - F.col("c")).select(F.col("p").alias("q"), "before")
    own = F.row_number().over(Window.partitionBy("p").orderBy(*order(sort, seq)))
    return part.join(F.broadcast(before), F.col("p") == F.col("q")).withColumn("rank", F.col("before") + own).drop("p", "q", "before")


def facets(hits: DataFrame) -> DataFrame:
    """facet, value, n for language (normalised), topic and difficulty, in one pass."""
    pair = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    one = hits.select(F.explode(F.array(pair("language", X.match_norm(F.col("language"))), pair("topic", F.col("topic")), pair("difficulty", F.col("difficulty")))).alias("x")).select("x.*")
    return one.where("value is not null and not (facet = 'difficulty' and value = '')").groupBy("facet", "value").agg(F.count("*").alias("n"))


def first_of_group(hits: DataFrame, group: str, keys: list[Column]) -> DataFrame:
    """The best row of each group, by a partial minimum of its sort keys."""
    w = Window.partitionBy(group).orderBy(*keys)
    return hits.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def variants(docs: DataFrame, group: str, id: str) -> DataFrame:
    """Pairs of an active document and another of its group."""
    other = docs.where("active").select(F.col(group).alias("g"), F.col(id).alias("variant_id"))
    return docs.join(other, (F.col(group) == F.col("g")) & (F.col(id) != F.col("variant_id"))).select(id, "variant_id")


def page(ranked_hits: DataFrame, page: int = 1, size: int = 10, cursor: str | None = None) -> DataFrame:
    size = max(1, min(size, SETTINGS.max_page_size))
    at = page_number(page, cursor)
    return ranked_hits.where(F.col("rank").between((at - 1) * size + 1, at * size))


def page_number(page: int, cursor: str | None) -> int:
    """A numeric cursor goes before the page."""
    return max(1, int(cursor)) if cursor and cursor.isascii() and cursor.isdigit() else max(1, page)


def pagination(total: int, page: int, size: int) -> dict:
    size = max(1, min(size, SETTINGS.max_page_size))
    return {"page": page, "page_size": size, "total_results": total, "total_pages": -(-total // size), "next_cursor": str(page + 1) if page * size < total else None}


def guidance(alternates: Column) -> Column:
    return F.array_distinct(F.concat(X.strings(L.GUIDANCE), F.slice(alternates, 1, 2)))


def no_results(query: str, filters: dict, alternates: list[str]) -> dict:
    """What to say when nothing is found."""
    return {"message": f"No strong results found for '{query}'.", "suggestions": list(dict.fromkeys([*L.GUIDANCE, *alternates[:2]])), "filters_to_relax": list(applied(filters))}
