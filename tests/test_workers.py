"""Python workers get the helpers with the job; the package is importable on the driver only."""

import os
import subprocess
import sys

from conftest import ROOT, SF

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from __spark_entry__ import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("missing_chi2", "forest_attribution", "forest_silhouette"):
    assert queries()[name](spark, {SF!r}).count() > 0
print("done")
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert run.returncode == 0 and run.stdout.strip().endswith("done"), run.stderr[-2000:]
