"""The filtering pipeline over ``documents``: stages in order, each written as Parquet and read again.

A stage takes all that its predecessor kept, and all but the last return the columns of
documents: toxic documents go, then those of low quality; of each group of near copies the one
with the smallest id stays; words in repeated passages are taken out; the rest is packed into
sequences of at most 2048 tokens.

Defined results: a null or empty text is scored like any other and, if it stays, is packed as its
end id alone; rows that share an id are judged each by its own text; of equal rows one stays unless
the text has no words; columns whose names an operator uses come through unchanged; an empty table
gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import blocks, jaccard, packing, rules, substring, toxicity
from larkspur.llm.session import ready


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a toxicity score of 0.5 or more go."""
    model = toxicity.trained(ready(spark), sf_dir)
    plain, names = blocks.numbered(docs)
    return blocks.restored(toxicity.score_toxicity(plain, model, names["text"]).where("score < 0.5"), docs, names)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with a quality score below 0.7 go."""
    model = rules.trained(ready(spark), sf_dir)
    plain, names = blocks.numbered(docs)
    return blocks.restored(rules.score_quality(plain, model, names["text"]).where("score >= 0.7"), docs, names)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near copies stays."""
    ready(spark)
    return jaccard.deduplicated(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: words in passages of 35 words or more that occur again are taken out."""
    ready(spark)
    return substring.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the pieces of all documents and their places in sequences."""
    ready(spark)
    return packing.packed_digests(docs)


STAGES = [("toxicity", clean), ("quality classifier", good), ("n-gram Jaccard join", apart), ("substring dedup", unrepeated), ("best-fit packing", packed)]
#: Classifiers and packing have no SQL; tests/llm holds each stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Work tables lie under the session's checkpoint folder, or the warehouse where none is set;
    each is deleted when the next is written, the last when the packing has its checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    at = f"{base}/pipeline-{uuid.uuid4().hex}"
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
        if k:
            deleted(spark, f"{at}/{k - 1}")
    deleted(spark, at)
    return docs


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever the session's file systems have it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
