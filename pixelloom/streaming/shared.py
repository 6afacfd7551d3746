"""Where streams keep what all executors must see."""

import os
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one set by ``setCheckpointDir``; a temporary one on a local master only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = by_call.get() if by_call.isDefined() else None
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or os.path.join(tempfile.gettempdir(), "checkpoints", "pixelloom")
