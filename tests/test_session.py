import os
import subprocess
import sys

from tidegrid.plans.backtest import PUBLISHED, origin_list, run_spec
from tests.conftest import hours

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OUTSIDE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
from tidegrid.catalogue import QUERIES
print("ROWS", QUERIES["f9_two_layer_sum"](spark, "/root/testdata/sf0.001").count())
from tidegrid import session
path = session.fresh_path(spark, "x")
spark.range(3).write.parquet(path)
"""


def test_workers_get_the_package_and_scratch_goes(tmp_path):
    """Started from another folder without PYTHONPATH."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    shared = tmp_path / "shared"
    out = subprocess.run([sys.executable, "-c", OUTSIDE.format(repo=REPO, shared=str(shared))], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert not [p for p in shared.glob("scratch-*/*")]


def test_single_holdout_window(spark, series):
    df = series({"a": hours("2014-01-01", [1.0] * 24 * 100)})
    row = origin_list(df, PUBLISHED["single_holdout"]).selectExpr(
        "string(origin)", "string(train_start)", "string(train_end)", "string(horizon_end)").collect()
    assert [tuple(r) for r in row] == [("2014-04-01 16:00:00", "2014-01-01 00:00:00", "2014-03-31 23:00:00", "2014-04-02 15:00:00")]


def test_published_runs_have_their_origins(spark):
    """Number of scored days and rows of training and validation of each published run, on a full hourly table."""
    df = spark.sql("SELECT 'a' AS series_id, explode(sequence(timestamp '2014-01-01', timestamp '2020-01-03', interval 1 hour)) AS ts")
    want = {"expanding_month": (31, 2168, 0), "rolling_quarter": (90, 2168, 0), "rolling_two_years": (365, 17529, 0),
            "boosted_from_february": (334, 17528, 32), "boosted_two_years": (365, 17528, 32), "boosted_three_years": (1095, 26288, 40),
            "boosted_summer": (92, 17528, 176), "smoothing_three_years": (1096, 8768, 0), "damped_trend_year": (366, 8768, 0)}
    for name, (origins, train, valid) in want.items():
        spec = run_spec(name)
        assert (origin_list(df, spec).count(), spec.train, spec.valid, spec.horizon, spec.score_from) == (origins, train, valid, 40, 17), name
