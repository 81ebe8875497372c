"""Cutting lineage in loops, and a place for files that are read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset, a folder of this process will do in local mode; a cluster has to name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="weftline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """The rows, dealt by a key and written: what is grouped by that key later on doesn't shuffle them again. (An adaptive plan would not say how its rows are dealt.)"""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(parts, key))
    finally:
        conf.set(name, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
