"""Queries on executors that share no memory with the driver, in a session of their own."""

import os
import subprocess
import sys

from tests.oracle import DATA

CODE = """
from pyspark.sql import SparkSession
from tests.oracle import compare
from textplan import io_queries
from textplan.registry import QUERIES, SQL
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {tmp!r} + "/warehouse").config("spark.checkpoint.dir", {tmp!r} + "/shared").config("spark.executorEnv.PYTHONPATH", {here!r}).getOrCreate()
compare(s, {data!r}, QUERIES[{name!r}], SQL[{name!r}])
s.stop()
print("SAME")
"""


def test_database_is_seen_by_every_executor(tmp_path):
    here = os.getcwd()
    code = CODE.format(tmp=str(tmp_path), here=here, data=f"{DATA}/sf0.001", name="load_database")
    r = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": here}, capture_output=True, text=True, timeout=180)
    assert "SAME" in r.stdout, r.stderr[-2000:]
