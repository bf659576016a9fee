"""Streams of many keys: rows that wait are kept in texts of a shard, queues of any length give what the batch operators give."""

import random

from pyspark.sql import functions as F
from test_log_streaming import END, N, played, tail

from tidewatch.operators import score
from tidewatch.operators.common import SECOND
from tidewatch.streaming import jobs


def test_many_keys_write_little(spark, tmp_path):
    keys, src = 3000, str(tmp_path / "in")
    df = spark.range(2 * keys).select(F.lit("b").alias("bucket"), (F.col("id") % keys).alias("key"), (F.expr(f"id div {keys}") * 5000 * SECOND + SECOND).alias("us"), F.col("id").alias("ord"), F.lit(1).cast("long").alias("w"))
    end = df.limit(1).withColumn("us", F.lit(END * SECOND))
    for part in (df.where(f"ord < {keys}"), df.where(f"ord >= {keys}"), end):
        part.coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(src).withColumn("ts", F.timestamp_micros("us"))
    q = jobs.stream_score(stream, 10_000, 2).writeStream.format("memory").queryName("many").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("many").count() == keys
    updated = sum(op["numRowsUpdated"] for p in q.recentProgress for op in p["stateOperators"])
    assert updated < 2.7 * 2 * keys, updated  # a row for what waits, its key, its time and its hit would be four


def test_long_queues(spark, tmp_path):
    """Sets that grow past what is kept with a key, shrink below it in a lull, and are emptied."""
    rng = random.Random(8)
    times = sorted([rng.randrange(1500) for _ in range(N // 3)] + [rng.randrange(1500, 3600) for _ in range(N // 12)])
    times += sorted(rng.randrange(3600, 4000) for _ in range(N - len(times)))
    data = [("b", f"k{o % 5 // 4}", t * SECOND, o, f"v{rng.randrange(120)}", f"10.0.0.{rng.randrange(99)}") for o, t in enumerate(times)]
    df = spark.createDataFrame(data, "bucket string, key string, us long, ord long, of string, ip string")
    of = df.drop("ip")
    got = played(spark, tmp_path / "d", of, lambda s: jobs.stream_distinct(s, 900, 68), of.schema, tail(spark, of))
    want = sorted(map(tuple, score.distinct_scores(of, 900, 68).select("bucket", "key", "us", "ord", "score", "crossed").collect()))
    assert sorted(got) == want and any(w[5] for w in want)
    spark.catalog.dropTempView("out")
    hits = df.select("bucket", F.col("ip").alias("key"), "us", "ord", F.lit(1).cast("long").alias("w"))
    last = tail(spark, hits).withColumn("key", F.lit("10.9.0.1"))
    got = played(spark, tmp_path / "n", hits, lambda s: jobs.stream_subnets(s, 24, 900, 90), hits.schema, last)
    want = [(r.bucket, r.cidr, r.us, r.ord, r.score, r.hits, sorted(r.members)) for r in score.subnet_crossings(hits, 24, 900, 90).collect()]
    assert sorted((*g[:6], sorted(g[6])) for g in got) == sorted(want) and want
    spark.catalog.dropTempView("out")
