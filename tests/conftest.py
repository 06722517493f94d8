import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(at / "wh")).config("spark.checkpoint.dir", str(at / "cp")).config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[1])
    return s
