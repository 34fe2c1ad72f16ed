"""Session builder with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, app: str = "lodestream", **conf: str) -> SparkSession:
    """UTC session zone, adaptive execution, Arrow transfer; ``conf`` overrides any setting.

    On a cluster leave ``master`` to the submitter, and ship the package with
    --py-files. Shuffle partitions are left to the cluster's configuration.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
