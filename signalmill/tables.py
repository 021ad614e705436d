"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine's only where it is unset and all runs in one process, as in tests."""
    target = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if target:
        return target
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rsplit("/", 1)[0]
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(target := tempfile.mkdtemp(prefix="signalmill-"))
    return target


def settled(df: DataFrame) -> DataFrame:
    """df, written and read again: its lineage is cut and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
