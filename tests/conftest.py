import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Build a files table from (path, content) pairs."""
    from pyspark.sql import functions as F

    from scanframe.functions import text

    def make(*pairs):
        df = spark.createDataFrame(list(pairs), "path string, content string")
        return df.select(
            "path", F.substring_index("path", "/", 1).alias("project"), text.language(F.col("path")).alias("lang"), "content")

    return make
