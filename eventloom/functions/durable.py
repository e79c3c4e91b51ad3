"""Cutting lineage in storage that every executor sees."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: spark.checkpoint.dir where the cluster names one. Where it is unset, one machine
    (a local master) takes a temporary folder; on several that is an error."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[[^-]|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="eventloom-checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def written(df: DataFrame) -> DataFrame:
    """df, written as a Parquet table in the checkpoint folder and read from it.

    For loops that join again and again: a checkpoint keeps the estimates of the plan before it, which joins multiply, and a
    table has the sizes of its files.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder; a lost executor does not lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
