"""The stored index: a catalogue's courses, postings and names as tables that every search reads.

Postings lie in order of term, so that a search for a few terms reads few row groups. Building costs
one pass over the catalogue; searches don't touch its texts again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators.prepare import prepared


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the session names for checkpoints; one beside the warehouse where none is set, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def materialised(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class StoredIndex:
    """Tables under a path: courses, postings, terms, features, names, vocabulary and stats."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._stats: dict | None = None

    @classmethod
    def build(cls, catalogue: DataFrame, path: str | None = None) -> StoredIndex:
        """Writes the tables; without a path, to a new folder under the shared one."""
        spark = catalogue.sparkSession
        self = cls(spark, path or f"{work_folder(spark)}/index-{uuid.uuid4().hex}")
        self._write(prepared(catalogue), "courses")
        c = self.table("courses")
        n = F.struct(F.size("all_terms").alias("all_len"), F.size("title_terms").alias("title_len")).alias("n")
        each = c.select("course_id", n, F.explode("all_terms").alias("term"), F.lit(1).alias("a"), F.lit(0).alias("t")).unionByName(c.select("course_id", n, F.explode("title_terms").alias("term"), F.lit(0).alias("a"), F.lit(1).alias("t")))
        posts = each.groupBy("term", "course_id").agg(F.sum("a").alias("tf"), F.sum("t").alias("title_tf"), F.first("n").alias("n")).select("term", "course_id", "tf", "title_tf", "n.*")
        self._write(posts.repartitionByRange("term").sortWithinPartitions("term", "course_id"), "postings")
        self._write(self.table("postings").where("tf > 0").groupBy("term").agg(F.count("*").alias("df")).withColumn("code", X.soundex_ref(F.col("term"))), "terms")
        features = c.select("course_id", F.explode(X.features(F.col("semantic_text"))).alias("f")).groupBy("course_id", "f").agg(F.count("*").alias("w"))
        norms = features.groupBy("course_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        self._write(features.join(norms, "course_id").repartitionByRange("f").sortWithinPartitions("f", "course_id"), "features")
        names = c.select("course_id", F.explode(F.concat(F.array(F.struct(F.col("title_norm").alias("norm"), F.lit(True).alias("title"))), F.transform("names", lambda x: F.struct(x.alias("norm"), F.lit(False).alias("title"))))).alias("x"))
        self._write(names.select("course_id", "x.*", F.replace("x.norm", F.lit(" "), F.lit("")).alias("compact")), "names")
        words = X.tokens(X.unicode_normalized(F.concat_ws(" ", "title", F.array_join("aliases", " "), F.array_join("tags", " "), F.array_join("transliterations", " "), "competency_name")))
        self._write(c.select(F.explode(words).alias("term")).distinct(), "vocabulary")
        floor = lambda x: F.greatest(F.coalesce(F.avg(F.size(x)), F.lit(1.0)), F.lit(1.0))
        self._write(c.agg(F.count("*").alias("n"), floor("all_terms").alias("all_avg"), floor("title_terms").alias("title_avg")), "stats")
        return self

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def stats(self) -> dict:
        """n, all_avg and title_avg; one row."""
        if self._stats is None:
            self._stats = self.table("stats").first().asDict()
        return self._stats

    def choices(self) -> DataFrame:
        """choice: the distinct titles and aliases, normalised."""
        return self.table("names").where("norm <> ''").select(F.col("norm").alias("choice")).distinct()

    def health(self) -> dict:
        try:
            return {"status": "up", "details": {"path": self.path, "document_count": int(self.table("stats").first()["n"])}}
        except Exception as e:  # an index that can't be read is reported, not raised
            return {"status": "degraded", "details": {"path": self.path, "reason": str(e).splitlines()[0]}}


def write_report(report: dict, spark: SparkSession, path: str) -> None:
    """One JSON object as text."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length of recordings."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")
