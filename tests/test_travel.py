"""Every query on executors that have no copy of the package: started from another folder, with nothing on their path."""

import os
import subprocess
import sys

SCRIPT = """
import importlib.util, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", {scratch!r}).config("spark.driver.memory", "3g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as entry
failed = []
for name, query in entry.queries().items():
    if not name.startswith({prefix!r}):
        continue
    try:
        query(spark, {data!r}).write.format("noop").mode("overwrite").save()
    except Exception as e:
        failed.append((name, str(e)[-300:]))
print("FAILED", failed)
spark.stop()
"""


def run_elsewhere(tmp_path, prefix):
    """What fails when the workers' folder is not the repository. The driver finds the package by sys.path only."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = SCRIPT.format(repo=repo, scratch=str(tmp_path / "shared"), data="/root/testdata/sf0.001", prefix=prefix)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "FAILED []" in done.stdout, done.stdout[-3000:] + done.stderr[-3000:]


def test_chunking_elsewhere(tmp_path):
    run_elsewhere(tmp_path, "cdc_")


def test_traces_elsewhere(tmp_path):
    run_elsewhere(tmp_path, "trace_")
