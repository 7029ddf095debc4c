"""What a Spark session needs for this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def workers_import_this(spark: SparkSession) -> SparkSession:
    """Lets Python workers on machines that see this folder import the package, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark
