"""Queries with Python workers must run from any working directory (the
package is shipped to executors, not found through the driver's cwd)."""

import os
import subprocess
import sys
import tempfile

from conftest import ROOT, SF_SMALL

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
print("ROWS", E.queries()["pnl_by_pair"](spark, {SF_SMALL!r}).count())
spark.stop()
"""


def test_python_worker_queries_run_outside_the_repo():
    cwd = tempfile.mkdtemp(prefix="qf-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                       timeout=600)
    assert "ROWS 200" in r.stdout, r.stderr[-2000:]
