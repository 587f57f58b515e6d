"""The folder for intermediate tables that all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or that which ``setCheckpointDir`` named.

    Where neither is set, a session on one machine (master ``local``) uses a
    folder in its warehouse and makes it the checkpoint folder; on a cluster
    that is an error, as executors must share the folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        context.setCheckpointDir(found)
    return found.rstrip("/")
