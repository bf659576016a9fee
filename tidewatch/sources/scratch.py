"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a folder of its own; on a cluster that is an error, for the driver's disk
    is not that of the executors."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if place is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in that folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in that folder: computed once, however often it is used, and safe from lost executors. ``by``: columns
    whose values are folders of it."""
    place = shared_path(df.sparkSession, label)
    df.write.partitionBy(*(by or [])).parquet(place)
    return df.sparkSession.read.parquet(place)
