"""The shared folder for what is written between jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """The shared checkpoint folder, set for the session; a temporary one only where Spark runs on one machine.

    It comes from ``spark.checkpoint.dir``. If a cluster names none, this
    raises, because a machine-local folder would lose files there.
    """
    sc = spark.sparkContext
    if known := sc.getCheckpointDir():
        return known
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="lodestream-checkpoint-")
    sc.setCheckpointDir(named)
    return named
