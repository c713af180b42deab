"""Python workers find the package from any working folder, and scratch goes with the driver."""

import os
import subprocess
import sys

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {entry!r})
e = importlib.util.module_from_spec(spec)
spec.loader.exec_module(e)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.checkpoint.dir", {shared!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
s.sparkContext.setLogLevel("ERROR")
print("rows", e.queries()["suggested"](s, "/root/testdata/sf0.001").count() > 0)
print("kept", e.queries()["masked_keys"](s, "/root/testdata/sf0.001").count(), e.queries()["appended"](s, "/root/testdata/sf0.001").count())
"""


def test_a_cluster_runs_from_another_folder(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    script = SCRIPT.format(entry=os.path.join(HOME, "__spark_entry__.py"), shared=str(shared))
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert out.returncode == 0, out.stderr[-3000:]
    assert "rows True" in out.stdout and "kept 150 10" in out.stdout
    assert not [n for _, _, names in os.walk(shared / "sparkloom") for n in names if n.endswith(".parquet")]
