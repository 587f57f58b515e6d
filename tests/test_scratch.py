"""The shared folder, in sessions of their own without any setting of the machine."""

import os
import subprocess
import sys

import pytest

CODE = """
from pyspark.sql import SparkSession
from textplan.sources.scratch import shared_dir
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {warehouse!r}){more}.getOrCreate()
class Cluster:
    conf = s.conf
    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(s.sparkContext.getCheckpointDir)
print("FOUND", shared_dir(Cluster if {cluster} else s))
"""


def run(tmp_path, more="", cluster=False):
    (tmp_path / "conf").mkdir(exist_ok=True)
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": os.getcwd()}
    code = CODE.format(warehouse=str(tmp_path / "warehouse"), more=more, cluster=cluster)
    return subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("more,cluster,want", [("", False, "/warehouse/_checkpoints"), ('.config("spark.checkpoint.dir", "/tmp/shared/")', True, "FOUND /tmp/shared\n"), ("", True, "set spark.checkpoint.dir")])
def test_shared_dir(tmp_path, more, cluster, want):
    r = run(tmp_path, more, cluster)
    assert want in (r.stderr if cluster and not more else r.stdout)
