"""The catalogue's schema, its loaders, and catalogues made of other tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.errors import ServiceError

COURSE = (
    "course_id string, group_id string, title string, aliases array<string>, synonyms array<string>, transliterations array<string>, description string, tags array<string>, instructor string, language string, "
    "available_languages array<string>, category string, topic string, competency_name string, levels array<string>, updated_on string, difficulty string, duration_minutes int, certification boolean, "
    "popularity_score double, recency_score double, active boolean, metadata map<string,string>"
)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of courses with the defaults for what is missing; doc_seq keeps the file's order."""
    try:
        df = spark.read.schema(COURSE).option("multiLine", True).json(path)
    except AnalysisException as e:
        raise ServiceError("sample_data_missing", "Configured sample data file was not found", 500, {"path": path}) from e
    empty = F.array().cast("array<string>")
    df = df.withColumns({c: F.coalesce(c, empty) for c in ("aliases", "synonyms", "transliterations", "tags", "available_languages", "levels")})
    df = df.withColumns({"group_id": F.coalesce("group_id", "course_id"), "popularity_score": F.coalesce("popularity_score", F.lit(0.0)), "recency_score": F.coalesce("recency_score", F.lit(0.0)), "active": F.coalesce("active", F.lit(True))})
    return df.withColumn("doc_seq", F.monotonically_increasing_id())


def spread(df: DataFrame) -> DataFrame:
    """A table whose files make fewer tasks than there are cores, dealt to all of them; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short titles with prices, sizes and brands, as a catalogue."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(
        F.col("p_partkey").alias("course_id"), F.col("p_partkey").alias("doc_seq"), F.col("p_name").alias("title"), F.col("p_name").alias("group_id"), F.col("p_brand").alias("instructor"), F.col("p_type").alias("category"),
        F.col("p_type").alias("topic"), F.lit("English").alias("language"), F.when(F.col("p_size") % 3 != 0, F.when(F.col("p_size") > 25, "advanced").otherwise("beginner")).alias("difficulty"), F.col("p_size").alias("duration_minutes"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 2 == 0).alias("certification"), F.col("p_retailprice").alias("popularity"), (F.col("p_size") / 50.0).alias("recency"), (F.col("p_size") != 13).alias("active"),
    )


def of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts; the title is the first 8 words."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return d.select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("title"), F.col("text").alias("body"), F.col("lang").alias("language"), F.col("source").alias("topic"))
