"""The rest works where the folders of the training-data operators were taken away, with or without the pipeline's file."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as e
names = e.queries()
assert len(names) > 100 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= set(names)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import os
if os.path.isdir("/root/testdata/sf0.001"):
    assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_subpackage(tmp_path, pipeline):
    there = tmp_path / "repo"
    shutil.copytree(REPO, there, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", "metastore_db"))
    if not pipeline:
        (there / "corpus_pipeline.py").unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=there, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
