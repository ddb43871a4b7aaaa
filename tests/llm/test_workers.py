"""The corpus queries where Python workers cannot import the package: another folder, no PYTHONPATH."""

import os
import subprocess
import sys
import tempfile

import pytest

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")

SCRIPT = f"""
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", {ROOT!r} + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
for name, query in entry.queries().items():
    if name.startswith("op") and name[2].isdigit():
        print(name, len(query(spark, {FOLDER!r}).collect()), flush=True)
"""


def test_queries_from_another_folder():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True, timeout=1_200)
    assert done.returncode == 0, done.stderr[-3_000:]
    names = [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")]
    assert len(names) == 13, done.stdout
