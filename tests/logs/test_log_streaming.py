"""Streams give what the batch operators give."""

import random

from pyspark.sql import functions as F

from tidewatch.functions.parse import parse_bsd_syslog
from tidewatch.operators import match, score, stages, state
from tidewatch.operators.common import SECOND
from tidewatch.streaming import jobs

N, END = 300, 10**6


def rows(seed=1):
    rng = random.Random(seed)
    times = sorted(rng.randrange(4000) for _ in range(N))
    return [(f"k{rng.randrange(4)}", t * SECOND, o, rng.choice(["set", "unset", "probe"]), f"v{rng.randrange(3)}") for o, t in enumerate(times)]


def played(spark, tmp_path, df, job, schema, last):
    """Write the table in four files in time order, then a row far later that lets the watermark pass; run the job."""
    src = tmp_path / "in"
    for k in range(4):
        df.where(F.expr(f"ord div {N // 4 + 1} = {k}")).coalesce(1).write.mode("append").json(str(src))
    last.coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    stream = stream.withColumn("ts", F.timestamp_micros("us"))
    q = job(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]) == 0
    return [tuple(r) for r in spark.table("out").collect()]


def tail(spark, df):
    """Two late rows of another key: the first moves the watermark, the second runs a batch behind it."""
    end = df.limit(1).withColumns({c: F.lit("end") if t == "string" else F.lit(END * SECOND) if c == "us" else F.col(c) for c, t in df.dtypes})
    return end


def test_scores(spark, tmp_path):
    df = spark.createDataFrame(rows(), "key string, us long, ord long, op string, value string").select(F.lit("b").alias("bucket"), "key", "us", "ord", F.lit(1).cast("long").alias("w"))
    got = played(spark, tmp_path, df, lambda s: jobs.stream_score(s, 300, 4), df.schema, tail(spark, df))
    assert sorted(got) == sorted(map(tuple, score.threshold_crossings(df, 300, 4).collect()))


def test_marks(spark, tmp_path):
    df = spark.createDataFrame(rows(2), "key string, us long, ord long, op string, value string").withColumns({"name": F.lit("m"), "ttl": F.lit(200)})
    got = played(spark, tmp_path, df, lambda s: jobs.stream_marks(s, 200), df.schema, tail(spark, df))
    live = state.as_of_marks(df.where("op = 'probe'").withColumn("id", F.col("ord")), df.where("op <> 'probe'"))
    want = {r.id: (r.value, r.first_set) for r in live.collect()}
    assert {g[3]: g[5:] for g in got if g[4]} == want
    assert len(got) == df.where("op = 'probe'").count()


def test_tracks_and_correlation_and_stages(spark, tmp_path):
    base = spark.createDataFrame(rows(3), "key string, us long, ord long, op string, value string")
    df = base.select("key", "us", "ord", (F.col("op") != "probe").alias("harvests"), F.when(F.col("op") == "set", F.col("value")).alias("f"))
    got = played(spark, tmp_path / "t", df, lambda s: jobs.stream_tracks(s, ["f"], 200), df.schema, tail(spark, df.withColumn("f", F.lit("x"))))
    want = {r.ord: (r.live_before, r.before_f, r.after_f) for r in state.tracks(df, ["f"], 200).collect()}
    assert {g[2]: g[3:] for g in got} == want
    spark.catalog.dropTempView("out")
    df = base.select("key", "us", "ord", (F.col("op") == "set").alias("capture"), "value")
    got = played(spark, tmp_path / "c", df, lambda s: jobs.stream_correlate(s, ["value"], 100, 100), df.schema, tail(spark, df))
    o = df.where("not capture").withColumn("id", F.col("ord")).drop("value", "capture")
    c = df.where("capture").withColumnRenamed("value", "src").drop("capture")
    now = {(r.id, r.src) for r in state.correlate_context(o, c, ["src"], 100).where("resolved").collect()}
    later = {(r.id, r.src) for r in state.correlate_deferred(o, c, ["src"], 100).collect()}
    assert {(g[1], g[4]) for g in got} == now | {x for x in later if x[0] not in {i for i, _ in now}}
    spark.catalog.dropTempView("out")
    df = base.select("key", "us", "ord", F.col("op").alias("stage"))
    want_stages = [stages.Stage("set", 2, 300), stages.Stage("unset", 1, 300)]
    got = played(spark, tmp_path / "s", df, lambda s: jobs.stream_stages(s, want_stages), df.schema, tail(spark, df))
    assert sorted(g[2] for g in got) == sorted(r.ord for r in stages.staged_sequence(df, want_stages).collect())


def test_lines(spark, tmp_path):
    rng = random.Random(5)
    data = [(f"s{o % 2}", 1000 * SECOND + o * SECOND * 2 // 3, o, rng.choice(["head", " more", " more"])) for o in range(N)]
    df = spark.createDataFrame(data, "source string, us long, ord long, line string")
    got = played(spark, tmp_path, df, lambda s: jobs.stream_join_multiline(s, r"^\s", 3, 2), df.schema, tail(spark, df))
    want = match.join_multiline(df.withColumnRenamed("ord", "seq"), r"^\s", 3, 2).orderBy("seq").collect()
    assert sorted((g[0], g[1], g[2]) for g in got) == sorted((r.source, r.seq, r.line) for r in want)  # the last ones too, on quiet


def test_parse_and_match(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("Oct 11 22:14:15 h sshd[1]: failed for bob from 1.2.3.4\nnoise\n")
    rule = match.Rule("fail", [r"failed for (?<USER>\S+) from %%%%SRC%%%%$"], only={"daemon": ["sshd"]})
    lines = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    q = jobs.stream_parse_match(lines, parse_bsd_syslog, [rule], ["daemon"]).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination()
    found = match.explode_offenders(match.explode_hits(spark.table("hits"))).collect()
    assert [(r.rule, r.ip, r.data["USER"]) for r in found] == [("fail", "1.2.3.4", "bob")]


def test_seeds(spark, tmp_path):
    """Streams that begin with what an earlier run left give the rest of one run's rows."""
    base = spark.createDataFrame(rows(6), "key string, us long, ord long, op string, value string").withColumns({"bucket": F.lit("b"), "w": F.lit(1).cast("long"), "of": F.when(F.col("op") != "unset", F.col("value"))})
    cut = 2000 * SECOND
    later = lambda df: df.where(F.col("us") > cut)
    df = base.select("bucket", "key", "us", "ord", "w")
    want = score.threshold_crossings(df, 300, 4)
    seed = score.live_hits(df, want, 300, cut).select("bucket", "key", "us", "ord", "w")
    got = played(spark, tmp_path / "s", later(df), lambda s: jobs.stream_score(s, 300, 4, seed=seed), df.schema, tail(spark, df))
    assert sorted(got) == sorted(map(tuple, later(want).collect())) and got
    spark.catalog.dropTempView("out")
    df = base.select("key", "us", "ord", "op", "value").withColumns({"name": F.lit("m"), "ttl": F.lit(200)})
    seed = state.live_marks(df.where("op <> 'probe'"), cut)
    got = played(spark, tmp_path / "m", later(df), lambda s: jobs.stream_marks(s, 200, seed=seed), df.schema, tail(spark, df))
    live = state.as_of_marks(df.where("op = 'probe'").withColumn("id", F.col("ord")), df.where("op <> 'probe'"))
    want = later(live.join(df.select(F.col("ord").alias("id"), "us"), "id"))
    assert {g[3]: g[5:] for g in got if g[4]} == {r.id: (r.value, r.first_set) for r in want.collect()}
    spark.catalog.dropTempView("out")


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """A key with 20,000 live hits: a micro-batch of a few rows updates a few rows of state."""
    live = 20_000
    seed = spark.range(live).select(F.lit("b").alias("bucket"), F.lit("k").alias("key"), (F.col("id") * 1000).alias("us"), F.col("id").alias("ord"), F.lit(1).cast("long").alias("w"))
    src = tmp_path / "in"
    for k in range(4):  # the watermark passes the first files' rows with the last
        few = spark.range(3).select(F.lit("b").alias("bucket"), F.lit("k").alias("key"), ((F.col("id") + 200 + 1000 * k) * SECOND).alias("us"), (F.col("id") + live + 3 * k).alias("ord"), F.lit(1).cast("long").alias("w"))
        few.coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(seed.schema).option("maxFilesPerTrigger", 1).json(str(src)).withColumn("ts", F.timestamp_micros("us"))
    job = jobs.stream_score(stream, 100_000, live + 7, seed=seed)
    q = job.writeStream.format("memory").queryName("heavy").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.score for r in spark.table("heavy").collect()] == [live + 7]
    updated = [op["numRowsUpdated"] for p in q.recentProgress for op in p["stateOperators"]]
    assert updated[0] >= live and max(updated[1:]) <= 40, updated
