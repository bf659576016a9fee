"""Parquet tables as the queries read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that is dealt out, from and up to.
SPREAD_FROM, SPREAD_TO = 1 << 20, 1 << 28


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``. A small one in fewer files than there are cores is dealt out to all of them: a file of one row
    group is one task, however much is done with its rows. Any other is read as it lies, without a shuffle."""
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    # lengths alone, no contents; one row comes back, however many files there are
    files = spark.read.format("binaryFile").load(path).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).head()
    return rows.repartition(cores) if files.n < cores and SPREAD_FROM <= files.size <= SPREAD_TO else rows
