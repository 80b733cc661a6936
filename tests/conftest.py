import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "8g")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """Folder of the smallest given tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def series(spark):
    """Make a series table from {series: [(stamp, value), ...]}."""
    def make(data):
        rows = [(s, ts, None if v is None else float(v)) for s, points in data.items() for ts, v in points]
        return spark.createDataFrame(rows, "series_id string, stamp string, value double").selectExpr(
            "series_id", "to_timestamp(stamp) AS ts", "value")
    return make


def hours(start, values):
    """[(stamp, value)] of consecutive hours."""
    import datetime as dt
    at = dt.datetime.fromisoformat(start)
    return [(str(at + dt.timedelta(hours=i)), v) for i, v in enumerate(values)]
