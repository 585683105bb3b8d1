import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a Column over literal rows: column(fn, [(in, ...), ...])."""

    def run(fn, rows, schema):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_n int, {schema}")
        out = df.select("_n", fn(df).alias("v")).collect()
        return [r["v"] for r in sorted(out, key=lambda r: r["_n"])]

    return run
