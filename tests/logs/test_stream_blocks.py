"""What streams hold for many keys: blocks of them, parts of the state by cores."""

from pyspark.sql import functions as F
from test_log_streaming import END

from tidewatch.operators.common import SECOND
from tidewatch.plans import more_queries
from tidewatch.streaming import jobs


class Table(dict):
    """A map state that counts what is asked of it."""

    calls = 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        self.pop(key, None)


class Value:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def getMapState(self, *_):  # noqa: N802
        self.table = Table()
        return self.table

    def getValueState(self, *_):  # noqa: N802
        return Value()


def test_blocks_grow_and_are_let_go():
    handle = Handle()
    states, want = jobs.States(handle), {}
    for turn in range(6):  # each turn changes, adds and removes keys, some of them null
        states.load()
        for k in range(turn * 300, turn * 300 + 600):
            key = ("b", k if k % 50 else None, f"é{k}")
            got = states.get(key)
            assert (got is None) == (key not in want) and (got is None or (got[0], got[1]) == want[key])
            if turn and k % 3 == 0:
                states.remove(key)
                want.pop(key, None)
            else:
                want[key] = (turn, [turn, ["x", None, k]])
                states.put(key, *want[key])
        states.save()
        states.load()
        assert states.keys == len(want) <= jobs.BLOCK * states.n
        assert all(states.get(k) == w for k, w in want.items())
    handle.table.calls = 0
    states.load()
    for key in want:
        states.get(key)
        states.put(key, 9, None)
    states.save()
    assert handle.table.calls <= 2 * states.n < len(want) / 8
    states.load()
    for key in want:
        states.remove(key)
    states.save()
    assert not handle.table and states.keys == 0


def test_keys_share_rows(spark, tmp_path):
    """Forty keys of each shard: a micro-batch updates a few rows of a shard, not one for each key."""
    keys, src = 40 * jobs.SHARDS, str(tmp_path / "in")
    df = spark.range(2 * keys).select(F.lit("b").alias("bucket"), (F.col("id") % keys).alias("key"), (F.expr(f"id div {keys}") * 5000 * SECOND + SECOND).alias("us"), F.col("id").alias("ord"), F.lit(1).cast("long").alias("w"))
    end = df.limit(1).withColumn("us", F.lit(END * SECOND))
    for part in (df.where(f"ord < {keys}"), df.where(f"ord >= {keys}"), end):
        part.coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(src).withColumn("ts", F.timestamp_micros("us"))
    q = jobs.stream_score(stream, 10_000, 2).writeStream.format("memory").queryName("shared").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("shared").count() == keys
    ops = [op for p in q.recentProgress for op in p["stateOperators"]]
    assert max(op["numRowsTotal"] for op in ops) < keys / 4, ops
    spark.catalog.dropTempView("shared")


def test_parts_go_by_cores(spark, sf):
    """The state has as many parts as there are cores, whatever shuffles are set to, and the setting stays."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        listener = jobs.LateRows()
        parts = []
        listener.onQueryProgress = lambda e: parts.extend(op.numShufflePartitions for op in e.progress.stateOperators)
        spark.streams.addListener(listener)
        try:
            more_queries._streamed(spark, sf, lambda r: jobs.stream_score(r.select(F.lit("b").alias("bucket"), F.col("user_id").alias("key"), "ts", "us", "ord", F.lit(1).cast("long").alias("w")), 86_400, 5), listener=listener)
        finally:
            spark.streams.removeListener(listener)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "37"
        assert parts and set(parts) == {spark.sparkContext.defaultParallelism}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
