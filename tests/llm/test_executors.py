"""Executors need no copy of the package: the driver alone knows where it is."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[2]
CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
sys.path.insert(0, ROOT)
from loomfield.llm.queries import QUERIES
def lacks(_):
    import importlib.util
    yield importlib.util.find_spec("loomfield") is None
assert spark.sparkContext.parallelize([1], 1).mapPartitions(lacks).collect() == [True], "the workers see the package"
for name in NAMES:
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_without_the_package(tmp_path):
    names = ["op3_decontaminate", "op7_suffix_dedup", "op11_periodic_runs", "op12_source_divergence", "op13_packing"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.replace("ROOT", repr(str(ROOT))).replace("NAMES", repr(names))
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    counted = dict(line.split() for line in run.stdout.splitlines() if line.startswith("op"))
    assert set(counted) == set(names) and int(counted["op7_suffix_dedup"]) == 200
