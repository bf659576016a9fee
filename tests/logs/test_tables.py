"""Small tables are dealt out to the cores, others are read as they lie; no row is lost or changed."""

from pyspark.sql import functions as F

from tidewatch.sources import tables


def test_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), (F.col("id") % 2).alias("half"))
    one, many, halves = (str(tmp_path / n) for n in ("one", "many", "halves"))
    rows.coalesce(1).write.parquet(one)
    rows.repartition(8).write.parquet(many)
    rows.coalesce(1).write.partitionBy("half").parquet(halves)
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    full = lambda df: df.agg(F.count("*"), F.sum("id"), F.sum(F.crc32(F.concat_ws("|", "id", "text", "half")))).head()
    dealt = tables.read_table(spark, one)
    assert (tasks(spark.read.parquet(one)), tasks(dealt)) == (1, spark.sparkContext.defaultParallelism)
    assert full(dealt) == full(rows) == full(tables.read_table(spark, halves))
    assert "Repartition" not in tables.read_table(spark, many)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(tables, "SPREAD_TO", 1 << 10)  # too large to be shuffled
    assert tasks(tables.read_table(spark, one)) == 1
    rows.limit(0).write.parquet(str(tmp_path / "none"))
    assert tables.read_table(spark, str(tmp_path / "none")).count() == 0
