"""The index as tables: postings, document frequencies, lengths, vocabulary; and its upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.errors import ServiceError
from larkspur.functions import text as X
from larkspur.settings import SETTINGS


def terms_of(docs: DataFrame, words: Column, *keep: str) -> DataFrame:
    """The columns to keep and a row for each word (term), the words being made once a row.

    The outer explode keeps the optimizer from inferring a filter on the words, which would make them a second time below a shuffle.
    """
    return docs.select(*keep, words.alias("words_")).select(*keep, F.explode_outer("words_").alias("term")).where("term IS NOT NULL")


def few(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has so few rows of a word or number that this is safe; else as it is."""
    return F.broadcast(df) if df.count() <= SETTINGS.broadcast_rows else df


def postings(docs: DataFrame, id: str, text: Column) -> DataFrame:
    """id, term, tf. Terms are exploded and counted with map-side partial sums; nothing is gathered per document."""
    return terms_of(docs, X.tokens(text), id).groupBy(id, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id: str, text: Column) -> DataFrame:
    return docs.select(id, F.size(X.tokens(text)).cast("long").alias("doc_len"))


def idf(posts: DataFrame, n: int | Column) -> DataFrame:
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    n = F.greatest(F.lit(n), F.lit(1))
    return df.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def average_length(lens: DataFrame) -> DataFrame:
    """One row; empty documents count, and the least is 1."""
    return lens.agg(F.greatest(F.coalesce(F.avg("doc_len"), F.lit(1.0)), F.lit(1.0)).alias("avg_len"), F.count("*").alias("n"))


def vocabulary(docs: DataFrame, *texts: Column) -> DataFrame:
    out = None
    for t in texts:
        part = terms_of(docs, X.tokens(t))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def title_choices(docs: DataFrame, *titles: Column) -> DataFrame:
    out = None
    for t in titles:
        part = docs.select(X.match_norm(t).alias("choice"))
        out = part if out is None else out.unionByName(part)
    return out.where("choice <> ''").distinct()


def upsert(corpus: DataFrame, batch: DataFrame, id: str, seq: str) -> DataFrame:
    """The last write of an id wins and the id keeps its first place.

    A row of the batch is later than any of the corpus, whatever its ``seq``; new ids come after
    all known ones, in the batch's order.
    """
    last, first = corpus.agg(F.coalesce(F.max(seq), F.lit(-1))).first()[0], batch.agg(F.min(seq)).first()[0]
    if first is None:
        return corpus
    both = corpus.withColumn("batch_no", F.lit(0)).unionByName(batch.withColumn(seq, F.col(seq) - first + last + 1).withColumn("batch_no", F.lit(1)), allowMissingColumns=True)
    by = Window.partitionBy(id)
    kept = both.withColumn("rn", F.row_number().over(by.orderBy(F.desc("batch_no"), F.desc(seq)))).withColumn("first_seq", F.min(seq).over(by)).where("rn = 1")
    return kept.withColumn(seq, F.col("first_seq")).drop("rn", "batch_no", "first_seq")


def delete(corpus: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    return corpus.join(ids.select(id).distinct(), id, "left_anti")


def required(batch: DataFrame, code: str) -> DataFrame:
    if batch.isEmpty():
        raise ServiceError(code, "The request holds no rows")
    return batch
