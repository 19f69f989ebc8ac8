"""Making the package importable for Python workers that don't start in its folder."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reach(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the path of workers on this machine. On a cluster, ship the package with --py-files."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def spool_to(spark: SparkSession):
    """A function that writes a DataFrame to the folder of spark.checkpoint.dir and reads it back; in local mode without one, DataFrame.checkpoint in a temporary folder."""
    import tempfile
    import uuid

    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="reelquery-")

    def spool(df):
        path = f"{given.rstrip('/')}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return spool
