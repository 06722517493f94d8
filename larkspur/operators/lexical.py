"""BM25 over postings, for a batch of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import index as I
from larkspur.settings import SETTINGS

WHOLE = ""


def bm25(docs: DataFrame, id: str, body: Column, query_terms: DataFrame, field: Column | None = None) -> DataFrame:
    """query_id, id, score: queries joined to postings on the term, then summed per pair.

    ``query_terms`` has query_id and term, a row for each occurrence. Idf is always the body's,
    the length average that of the field scored.
    """
    # Terms are never empty: the empty one stands for a document as a whole, found or not, so that one pass gives lengths too.
    whole = query_terms.sparkSession.createDataFrame([(WHOLE,)], "term string")
    wanted = I.few(query_terms.select("term").distinct().unionByName(whole))

    def found(text: Column) -> DataFrame:
        """id, term, tf, total_len (the length, tf times) of the terms asked for and of each document as a whole.

        The others are dropped before anything is shuffled.
        """
        words = docs.select(id, F.concat(X.tokens(text), F.array(F.lit(WHOLE))).alias("w")).select(id, "w", (F.size("w") - 1).alias("doc_len"))
        return I.terms_of(words, F.col("w"), id, "doc_len").join(wanted, "term", "left_semi").groupBy(id, "term").agg(F.count("*").alias("tf"), F.sum("doc_len").alias("total_len"))

    posts = found(body if field is None else field)
    # Document frequencies only of the terms asked for; their table has at most as many rows as the queries have terms.
    # All uses of the postings read both their numbers, and none filters them, so that Spark sees one plan and tokenises once.
    used = (F.col("tf") > 0) & (F.col("total_len") >= 0)
    df = (posts if field is None else found(body)).groupBy("term").agg(F.count(F.when(used, 1)).alias("df"))
    # Of tables without rows, one row: the least length is 1.
    stats = posts.agg(*(F.sum(F.when(F.col("term") == WHOLE, F.col(c))).alias(c) for c in ("tf", "total_len")))
    stats = stats.select(F.greatest(F.coalesce(F.col("total_len") / F.col("tf"), F.lit(1.0)), F.lit(1.0)).alias("avg_len"), F.coalesce("tf", F.lit(0)).alias("n"))
    idf = df.crossJoin(stats).select("term", "avg_len", F.log(1 + (F.greatest("n", F.lit(1)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hits = posts.withColumn("doc_len", F.col("total_len") / F.col("tf")).join(query_terms.join(idf, "term"), "term")
    k1, b = SETTINGS.k1, SETTINGS.b
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.greatest("doc_len", F.lit(1.0)) / F.col("avg_len")))
    return hits.groupBy("query_id", id).agg(F.round(F.sum(part), 4).alias("score"))


def top(scores: DataFrame, k: int, id: str) -> DataFrame:
    """The k best of each query, ties to the smaller id; row_number lets Spark cut each partition early."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
