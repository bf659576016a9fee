"""Contiguous shards of near-equal bytes from global prefix sums. DataFrame operations only.

Documents fall into buckets of consecutive ids. The buckets' totals, a small table, give the bytes and
rows that stand before each bucket; a running sum inside the bucket does the rest, so no task ever
holds more than one bucket. Shards are cut where the global sum passes equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS = 40
#: Bytes that a document has besides its text.
OVERHEAD = 16
#: Buckets for each shuffle partition: many, so that partitions hold about the same number of rows.
BUCKETS_A_PARTITION = 4


def shards(docs: DataFrame, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): law ``bytes``, shards contiguous by id.

    A document goes to the shard in which the middle of its bytes lies, so a shard differs from its
    target by one document at most. Null text has no bytes; null ids come first; rows with one id are
    ordered by size and checksum; copies are placed like any other row; one shard takes at most one
    more row than fits when a text is longer than a shard; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc")
    )
    buckets = BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The written copy fixes which rows are in which bucket.
    placed = cut(narrow.repartitionByRange(buckets, "id", "size", "crc").withColumn("bucket", F.spark_partition_id()))

    before = Window.orderBy("bucket")  # over one row a bucket
    totals = placed.groupBy("bucket").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    totals = totals.select("bucket", (F.sum("b").over(before) - F.col("b")).alias("bytes_before"), F.sum("b").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("bucket").orderBy("id", "size", "crc")
    shard = F.expr(f"least((2 * (bytes_before + upto) - size) * {n} div (2 * total), {n - 1})").cast("int")
    summed = (
        placed.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(totals), "bucket")  # one row a bucket
        .withColumn("shard", shard)
        .withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id", "size", "crc")))
    )
    summed = cut(summed.select("id", "size", "crc", "bucket", "shard", "rank"))
    runs = summed.groupBy("bucket", "shard").agg(F.count("*").alias("r"))  # a row for each bucket, and one for each cut
    starts = runs.select("bucket", "shard", (F.sum("r").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("r")).alias("start"))
    return summed.join(F.broadcast(starts), ["bucket", "shard"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


_CRC_TABLE = """select list(c order by i) as t from (
  select i, list_reduce(list_prepend(i, range(8)::bigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
  from (select unnest(range(256))::bigint as i))"""

ORACLE = f"""
with tbl as ({_CRC_TABLE}),
bytes as (
  select doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) + {OVERHEAD} as size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as b
  from documents),
sized as (
  select doc_id, size,
         xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) as crc
  from bytes, tbl),
summed as (
  select *, sum(size) over (order by doc_id nulls first, size, crc rows unbounded preceding) as upto, sum(size) over () as total from sized),
cut as (select *, least((2 * upto - size) * {SHARDS} // (2 * total), {SHARDS - 1})::integer as shard from summed)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard,
       row_number() over (partition by shard order by doc_id nulls first, size, crc) - 1 as slot, null::integer as grown_shard
from cut
"""
