"""Where jobs put what several executors read: the folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and the master is local, a temporary folder. On a cluster it must be set, as
    executors don't see each other's folders."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.driftspark.scratch", None)
    if not given:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="spark-driftspark-")
        spark.conf.set("spark.driftspark.scratch", given)
    return given


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/driftspark/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back from there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
