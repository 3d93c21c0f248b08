"""Written tables in a session without spark.checkpoint.dir."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
from pyspark.sql import SparkSession
from wordloom.operators.lookup import node_ids
from wordloom.sources.catalog import shared_folder
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark.newSession())
print(sorted(r.node_id for r in node_ids(spark.createDataFrame([("b",), ("a",)], "node string")).collect()))
"""


def test_a_local_session_gets_a_folder_of_its_own(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path)}, cwd=root)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip().endswith("[0, 1]")
