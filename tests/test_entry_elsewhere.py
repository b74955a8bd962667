"""The driver contract from another working directory: Python stages must
find the package on the workers (shipped with addPyFile), not via cwd."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
print("ENTRY", m.entry(spark).count())
print("IMPUTE", m.queries()["impute_train_test"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_entry_and_python_stage_from_another_directory():
    d = tempfile.mkdtemp(prefix="elsewhere-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=d, env=env, capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = dict(line.split() for line in out.stdout.splitlines() if line.startswith(("ENTRY", "IMPUTE")))
    assert int(lines["ENTRY"]) > 0 and int(lines["IMPUTE"]) > 0
