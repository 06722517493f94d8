"""Prepares a session: the package on its Python workers, and Arrow batches of a bounded size."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "4m"
ROOT = str(Path(__file__).resolve().parents[2])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of all documents; where their files make fewer tasks than there are cores, dealt to all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores else docs


def ready(spark: SparkSession) -> SparkSession:
    """Workers on this machine find the package by path; on a cluster submit it with --py-files."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    # Batches to and from Python by bytes, as texts may be long; 10,000 rows of them are too much at once.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark
