"""All queries on texts and the pipeline, while only the driver can import the package."""

import os
import subprocess
import sys

from conftest import ROOT, SF

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from profilekit.llm.queries import QUERIES
import corpus_pipeline
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
for name, query in (QUERIES | {{"pipeline": corpus_pipeline.run}}).items():
    assert query(spark, {SF!r}).count() > 0, name
print("done", len(QUERIES))
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0 and run.stdout.strip().endswith("done 13"), run.stderr[-2000:]
