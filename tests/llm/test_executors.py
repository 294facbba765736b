"""Operators run by workers that cannot import this package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[2]

# The path is changed in the driver alone: workers start in a folder without the package.
SCRIPT = f"""
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {str(ROOT)!r})
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
spark = spark.config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
from ledgerloom.llm import queries
for name in sys.argv[2:]:
    queries.QUERIES[name](spark, {SF_DIR!r}).write.format("noop").mode("overwrite").save()
    print("ran", name)
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")
def test_workers_need_no_copy_of_the_package(tmp_path):
    names = [
        "op2_interval_expansion_dedup",
        "op4_naive_bayes_support_vectors",
        "op7_deletion_neighbourhood_lines",
        "op12_transducer_divergence_audit",
        "op13_chunked_warc",
    ]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    work = tmp_path / "work"
    work.mkdir()
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "shared"), *names], cwd=work, env=env, capture_output=True, text=True)
    assert [line for line in run.stdout.splitlines() if line.startswith("ran ")] == [f"ran {name}" for name in names], run.stderr[-3000:]
