"""Registered queries of the sources, sinks and streams: tables are written, read or streamed back, and compared."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import parse_bsd_syslog
from ..operators import gates as G
from ..operators import score as C
from ..operators import stages as ST
from ..operators import state as K
from ..operators.common import micros
from ..operators.match import join_multiline
from ..sources import logs
from ..sources.scratch import shared_path, written
from ..streaming import jobs
from . import queries as Q
from .data import DAY, LINES, SQL, hits, table

#: What the watermark has passed at the end of a stream: everything until ten minutes before its last row.
BEHIND = "(select (max(us) // 1000 - 600000) * 1000 from h where {})"


#: Files that the events are streamed from, at least, and rows of one at most: a micro-batch takes one.
SLICES, SLICE_ROWS = 4, 1_000_000


def _in_time(spark: SparkSession, sf: str, late: Column | None = None) -> str:
    """The events as files in the order of time, one slice of time each. Rows that are ``late`` come after all others."""
    ev, place = table(spark, sf, "events").withColumn("us", micros()), shared_path(spark, "events")
    n = max(SLICES, -(-ev.count() // SLICE_ROWS))
    timely = ev if late is None else ev.where(~late)
    cut = written(timely.repartitionByRange(n, "us").withColumn("slice", F.spark_partition_id()), "slices", ["slice"])
    for k in range(n):  # one after another, each reads its own slice: the source goes by the files' times
        cut.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(place)
    if late is not None:
        ev.where(late).coalesce(1).write.mode("append").parquet(place)
    return place


def _streamed(spark: SparkSession, sf: str, job: Callable[[DataFrame], DataFrame], late: Column | None = None, listener: jobs.LateRows | None = None) -> DataFrame:
    """Stream the events through a job to files, slice by slice, and read what it has written."""
    place = _in_time(spark, sf, late)
    ev = spark.readStream.schema(spark.read.parquet(place).schema).option("maxFilesPerTrigger", 1).parquet(place)
    ev = ev.repartition(spark.sparkContext.defaultParallelism)  # a slice is one file, which one task reads
    rows = ev.select("event_id", "us", F.timestamp_micros("us").alias("ts"), "user_id", "event_type", F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int").alias("k"), F.col("event_id").alias("ord"))
    rows = rows.withColumn("ip", F.expr("concat('10.', user_id % 4, '.', k % 8, '.', user_id % 50 + 1)"))
    out, made = shared_path(spark, "stream"), job(rows)
    # every micro-batch opens and commits each part of the state: as many as cores, however large the table
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    try:
        query = made.writeStream.format("parquet").option("checkpointLocation", shared_path(spark, "offsets")).option("path", out).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    query.awaitTermination()
    if listener is not None:
        listener.of(query)
    return spark.read.schema(made.schema).parquet(out)


@Q.query(Q.fold_sql("user_id", "1", DAY, 5) + "select 'kur:web' as bucket, key, us, ord, score from st where crossed and us <= " + BEHIND.format("true"))
def stream_score(spark, sf):  # noqa: ANN001, ANN201
    return _streamed(spark, sf, lambda r: jobs.stream_score(r.select(F.lit("kur:web").alias("bucket"), F.col("user_id").alias("key"), "ts", "us", "ord", F.lit(1).cast("long").alias("w")), DAY, 5))


@Q.query(Q._LIVE + "select p.ord, l.id is not null as live, l.value, l.first_set from p left join (select * from live where name = 'bad') l using (id) where p.us <= " + BEHIND.format("event_type in ('error', 'purchase', 'view')"))
def stream_marks(spark, sf):  # noqa: ANN001, ANN201
    op = F.when(F.col("event_type") == "view", "probe").when(F.col("event_type") == "purchase", "unset").otherwise("set")

    def job(r: DataFrame) -> DataFrame:
        r = r.where(F.col("event_type").isin("error", "purchase", "view"))
        r = r.select(F.lit("bad").alias("name"), F.col("user_id").alias("key"), "ts", "us", "ord", op.alias("op"), F.concat(F.lit("v"), F.col("k") % 2).alias("value"), F.lit(2 * DAY).alias("ttl"))
        return jobs.stream_marks(r, 2 * DAY)

    return _streamed(spark, sf, job).select("ord", "live", "value", "first_set")


@Q.query(Q.TRACK_SQL + "select event_id as ord, live_before, before_addr as before, after_addr as after from r where us <= " + BEHIND.format("true"))
def stream_tracks(spark, sf):  # noqa: ANN001, ANN201
    row = [F.col("user_id").alias("key"), "ts", "us", "ord", F.col("event_type").isin("click", "error").alias("harvests"), F.when(F.col("event_type") == "error", F.col("ip")).alias("addr")]
    return _streamed(spark, sf, lambda r: jobs.stream_tracks(r.select(*row), ["addr"], DAY)).select("ord", "live_before", F.col("before_addr").alias("before"), F.col("after_addr").alias("after"))


@Q.query(SQL + f""", c as (select user_id as key, us, ip from h where event_type = 'click'), o as (select event_id as id, user_id as key, us from h where event_type = 'purchase'),
b as (select o.*, case when c.us + {DAY * 1_000_000} > o.us then c.ip end as now from o asof left join c on o.key = c.key and o.us >= c.us),
f as (select b.*, c.us as later_us, c.ip as later from b asof left join c on b.key = c.key and b.us < c.us)
select id as offense_ord, case when now is not null then us else later_us end as us, coalesce(now, later) as value from f
where (now is not null or us + {DAY * 1_000_000} > later_us) and case when now is not null then us else later_us end <= """ + BEHIND.format("event_type in ('click', 'purchase')"))
def stream_correlate(spark, sf):  # noqa: ANN001, ANN201
    def job(r: DataFrame) -> DataFrame:
        r = r.where(F.col("event_type").isin("click", "purchase"))
        return jobs.stream_correlate(r.select(F.col("user_id").alias("key"), "ts", "us", "ord", (F.col("event_type") == "click").alias("capture"), F.col("ip").alias("value")), ["value"], DAY, DAY)

    return _streamed(spark, sf, job).select("offense_ord", "us", "value")


@Q.query(Q.ORACLES["staged_sequence"].replace(", seen as k, ip from", " from") + " and us <= " + BEHIND.format("true"))
def stream_stages(spark, sf):  # noqa: ANN001, ANN201
    stage = F.when(F.col("event_type") == "click", "try").when(F.col("event_type") == "purchase", "in")
    plan = [ST.Stage("try", 2, 2 * DAY), ST.Stage("in", 1, 2 * DAY)]
    return _streamed(spark, sf, lambda r: jobs.stream_stages(r.select(F.col("user_id").alias("key"), "ts", "us", "ord", stage.alias("stage")), plan)).withColumn("n_hits", F.col("n_hits").cast("int"))


@Q.query(Q.ORACLES["distinct_score"] + " where us <= " + BEHIND.format("true"))
def stream_distinct(spark, sf):  # noqa: ANN001, ANN201
    row = [F.lit("kur:web").alias("bucket"), F.col("user_id").alias("key"), "ts", "us", "ord", Q._seldom((F.col("k") % 10).cast("string")).alias("of")]
    return _streamed(spark, sf, lambda r: jobs.stream_distinct(r.select(*row), 2 * DAY, 4)).drop("bucket")


@Q.query(Q.ORACLES["value_count"] + " where us <= " + BEHIND.format("true"))
def stream_values(spark, sf):  # noqa: ANN001, ANN201
    row = [F.lit("kur:web").alias("bucket"), "key", "ts", "us", "ord", "of", "offender"]
    return _streamed(spark, sf, lambda r: jobs.stream_values(Q._value_hits(r).select(*row), DAY, 30)).drop("bucket")


@Q.query(Q.ORACLES["subnet_score"].replace(", us as last", "") + " and us <= " + BEHIND.format("true"))
def stream_subnets(spark, sf):  # noqa: ANN001, ANN201
    w = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1).cast("long")
    row = [F.lit("kur:web").alias("bucket"), Q._mixed("ip", "event_id").alias("key"), "ts", "us", "ord", w.alias("w")]
    got = _streamed(spark, sf, lambda r: jobs.stream_subnets(r.select(*row), 24, DAY, 30, prefix_v6=48))
    return got.select(F.col("key").alias("cidr"), "us", "ord", "score", "hits", "first", F.array_join("members", ",").alias("members"))


@Q.query(SQL + f""", l as (select user_id as source, us, ord, case when event_type = 'click' then 'head ' else ' ' end || ord as line, event_type = 'click' as opens, lag(us) over (partition by user_id order by us, ord) as before from h),
r as (select *, sum(case when opens or before is null or us - before >= {2 * DAY * 1_000_000} then 1 else 0 end) over (partition by source order by us, ord) as rec from l),
c as (select *, (row_number() over (partition by source, rec order by us, ord) - 1) // 3 as chunk from r),
g as (select source, rec, chunk, arg_min(ord, (us, ord)) as seq, string_agg(line, chr(10) order by us, ord) as line, count(*) as n_lines, min(us) as begins, max(us) as ends from c group by source, rec, chunk),
n as (select *, lead(begins) over (partition by source order by rec, chunk) as next from g)
select source, seq, line, n_lines from n where coalesce(next <= """ + BEHIND.format("true") + f", false) or ends + {2 * DAY * 1_000_000} <= " + BEHIND.format("true"))
def stream_join_multiline(spark, sf):  # noqa: ANN001, ANN201
    line = F.concat(F.when(F.col("event_type") == "click", "head ").otherwise(" "), "ord")
    return _streamed(spark, sf, lambda r: jobs.stream_join_multiline(r.select(F.col("user_id").alias("source"), "ts", "us", "ord", line.alias("line")), r"^ ", 3, 2 * DAY, "10 minutes"))


@Q.query(SQL + """, q as (select min(us) + (max(us) - min(us)) // 4 as cut from h) select count(*) as dropped from h, q where us < cut and user_id % 5 = 0""")
def late_rows(spark, sf):  # noqa: ANN001, ANN201
    """Rows that come after the watermark has passed them are dropped, and counted."""
    span = table(spark, sf, "events").select(F.min(micros()).alias("a"), F.max(micros()).alias("b")).head()
    late = (F.col("us") < span.a + (span.b - span.a) // 4) & (F.col("user_id") % 5 == 0)
    listener = jobs.LateRows()
    spark.streams.addListener(listener)
    try:
        row = [F.lit("kur:web").alias("bucket"), F.col("user_id").alias("key"), "ts", "us", "ord", F.lit(1).cast("long").alias("w")]
        _streamed(spark, sf, lambda r: jobs.stream_score(r.select(*row), DAY, 5), late, listener)
    finally:
        spark.streams.removeListener(listener)
    return Q.values(spark, "dropped long", [(sum(listener.dropped.values()),)])


@Q.query(Q.RULE_SQL + "select event_id, rule, ip from m")
def stream_parse_match(spark, sf):  # noqa: ANN001, ANN201
    from ..operators import match as M

    def job(r: DataFrame) -> DataFrame:
        clock = {"dd": "cast(1 + us div 86400000000 % 28 as int)", "hh": "cast(us div 3600000000 % 24 as int)", "mi": "cast(us div 60000000 % 60 as int)", "ss": "cast(us div 1000000 % 60 as int)"}
        line = r.selectExpr("*", *(f"{e} as {n}" for n, e in clock.items())).selectExpr("event_id", f"{LINES['bsd']} as line")
        return M.explode_offenders(M.explode_hits(jobs.stream_parse_match(line, parse_bsd_syslog, Q.RULES, ["daemon"]))).select("event_id", "rule", "ip")

    return _streamed(spark, sf, job)


@Q.query(SQL + "select count(*) as lines, count(*) filter (event_id % 17 <> 0 and k * 2 <= 191) as parsed, count(distinct event_id % 4)::bigint as files from h")
def log_files(spark, sf):  # noqa: ANN001, ANN201
    """read_logs: lines written as text files are read with their source."""
    place = shared_path(spark, "lines")
    hits(spark, sf).selectExpr(f"{LINES['bsd']} as line", "event_id % 4 as part").write.partitionBy("part").text(place)
    rows = logs.read_logs(spark, f"{place}/part=*").select(parse_bsd_syslog(F.col("line")).isNotNull().alias("ok"), F.regexp_extract("source", r"part=(\d+)", 1).alias("part"))
    return rows.agg(F.count("*").alias("lines"), F.count_if("ok").alias("parsed"), F.count_distinct("part").alias("files"))


@Q.query(SQL + """, l as (select event_id, event_id % 4 as part, case when event_id % 3 = 0 then '' else '  ' end || event_type || ' ' || event_id as line from h),
n as (select *, sum(octet_length(encode(line)) + 1) over (partition by part order by event_id) as until, row_number() over (partition by part order by event_id) as n from l),
r as (select *, sum(case when event_id % 3 = 0 or n = 1 then 1 else 0 end) over (partition by part order by event_id) as rec from n)
select part::int as part, min(until - octet_length(encode(line)) - 1)::bigint as at, max(until)::bigint as until, md5(string_agg(line, chr(10) order by event_id)) as line_md5, count(*)::int as n_lines from r group by part, rec""")
def ordered_files(spark, sf):  # noqa: ANN001, ANN201
    """read_log_offsets and join_multiline of its blocks: records of several lines with the bytes of the file they stand in."""
    place = shared_path(spark, "ordered")
    line = F.concat(F.when(F.col("event_id") % 3 == 0, "").otherwise("  "), "event_type", F.lit(" "), "event_id")
    rows = hits(spark, sf).select("event_id", (F.col("event_id") % 4).alias("part"), line.alias("line")).repartition(4, "part").sortWithinPartitions("part", "event_id")
    rows.select("part", "line").write.partitionBy("part").text(place)
    lines = written(logs.read_log_offsets(spark, f"{place}/part=*"), "ordered")  # read by both steps below
    glued = join_multiline(lines, r"^\s", max_lines=1000, block=F.col("seq.block"))
    ends = lines.select("source", "seq", "at")
    begun = glued.join(ends, ["source", "seq"])
    size = F.octet_length("line") + 1
    part = F.regexp_extract("source", r"part=(\d+)", 1).cast("int")
    return begun.select(part.alias("part"), "at", (F.col("at") + size).alias("until"), F.md5("line").alias("line_md5"), "n_lines")


@Q.query(SQL + """select event_id % 17 <> 0 as parsed, count(*) as n, count(distinct case when event_id % 17 <> 0 then ip end) as addresses from h group by 1""")
def ndjson_files(spark, sf):  # noqa: ANN001, ANN201
    place = shared_path(spark, "ndjson")
    hits(spark, sf).selectExpr(f"{LINES['json']} as line").write.text(place)
    rows = logs.read_ndjson_logs(spark, place)
    return rows.groupBy(F.col("raw").isNotNull().alias("parsed")).agg(F.count("*").alias("n"), F.count_distinct(F.try_variant_get("raw", "$.src.ip", "string")).alias("addresses"))


@Q.query(Q.LEDGER_SQL + f"select epoch, kur, ip, 'rule \"x\", y' as rule from g, now where t - epoch < {10 * DAY}")
def ledger_files(spark, sf):  # noqa: ANN001, ANN201
    """append_ledger in two runs, read_ledger, compact_ledger."""
    place = shared_path(spark, "ledger")
    bans = Q._ledger(spark, sf).select("epoch", "kur", "ip", F.lit('rule "x",\r\n y').alias("rule"), F.lit("w").alias("watcher"))
    for half in (0, 1):
        logs.append_ledger(bans.where(F.pmod("epoch", F.lit(2)) == half), place)
    compacted = shared_path(spark, "ledger")
    logs.compact_ledger(spark, place, compacted, Q._now(spark, sf), keep=10 * DAY)
    return logs.read_ledger(spark, compacted).drop("watcher")


@Q.query(Q.EVENTS_SQL + "select ord, event_type, ip as src_ip, null::varchar as dest_ip, score from e")
def event_files(spark, sf):  # noqa: ANN001, ANN201
    """write_events as NDJSON by type, read_events."""
    place = shared_path(spark, "events")
    logs.write_events(Q._events(spark, sf).select("event_type", "ord", "score", F.col("ip").alias("src_ip"), F.lit(None).cast("string").alias("dest_ip")), place)
    return logs.read_events(spark, place, "ord long, event_type string, src_ip string, dest_ip string, score long")


@Q.query(Q.MARKS_SQL + f""", tt as (select max(us) as t from h), l as (select *, row_number() over (partition by name, key order by us desc, ord desc) as n from fs),
d as (select concat('10.', user_id % 4, '.', k % 8, '.0/24') as net, us, w, ip, max(us) over (partition by user_id % 4, k % 8) as newest from h),
tr as ({Q.ORACLES["live_tracks"]})
select 'hit' as family, user_id::varchar as key, us, w, null::bigint as expires, null::varchar as member from h, tt where user_id in (select user_id from h, tt group by user_id, t having t - max(us) <= {DAY * 1_000_000})
union all select 'mark', key::varchar, null, null, expires, null from l, tt where n = 1 and is_set and expires > t
union all select 'track', key, null, null, expires, addr from tr, tt where expires > t
union all select 'subnet', net, us, w, null, ip from d, tt where t - newest <= {DAY * 1_000_000}""")
def state_files(spark, sf):  # noqa: ANN001, ANN201
    """snapshot_state of hits, marks, tracks and deposits on networks, then seed_state for the next run."""
    place, rows = shared_path(spark, "state"), hits(spark, sf)
    at = rows.agg(F.max("us")).head()[0]
    marks = K.live_marks(Q._marks(spark, sf), at).withColumn("key", F.col("key").cast("string"))
    tracks = Q.QUERIES["live_tracks"](spark, sf).select(F.lit("session").alias("name"), "key", "expires", F.create_map(F.lit("addr"), F.col("addr")).alias("fields"))
    kept = rows.select("bucket", F.col("user_id").cast("string").alias("key"), "us", "ord", "w", F.lit(None).cast("string").alias("of"))
    deposits = C.subnet_deposits(rows.select("bucket", F.col("ip").alias("key"), "us", "ord", "w"), 24)
    logs.snapshot_state(place, kept, marks, tracks, deposits)
    seed = logs.seed_state(spark, place, at)
    none = F.lit(None)
    row = lambda family, df, us, w, expires, member: df.select(F.lit(family).alias("family"), "key", us.cast("long").alias("us"), w.cast("long").alias("w"), expires.cast("long").alias("expires"), member.cast("string").alias("member"))
    us, w, expires = F.col("us"), F.col("w"), F.col("expires")
    parts = [row("hit", seed.hits, us, w, none, none), row("mark", seed.marks, none, none, expires, none)]
    parts += [row("track", seed.tracks, none, none, expires, F.col("fields")["addr"]), row("subnet", seed.deposits, us, w, none, F.col("member"))]
    return reduce(DataFrame.unionByName, parts)


def _halves(spark: SparkSession, sf: str) -> tuple[int, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """The middle of the events' time, and what keeps the rows up to it, and those after it."""
    ends = hits(spark, sf).agg(F.min("us").alias("a"), F.max("us").alias("b")).head()
    at = ends.a + (ends.b - ends.a) // 2
    return at, lambda df: df.where(F.col("us") <= at), lambda df: df.where(F.col("us") > at)


def _left_over(spark: SparkSession, at: int, **state: DataFrame) -> logs.State:
    """What a run leaves, written as a snapshot and read for the next."""
    place = shared_path(spark, "state")
    none = {"hits": "bucket string, key string, us long, ord long, w long, of string", "marks": "name string, key string, value string, expires long, first_set long"}
    state = {n: Q.values(spark, schema, []) for n, schema in none.items()} | state
    logs.snapshot_state(place, state["hits"], state["marks"], state.get("tracks"), state.get("deposits"))
    return logs.seed_state(spark, place, at, idle=10 * DAY)


@Q.query(Q.fold_sql("user_id", "1", DAY, 5) + "select key, us, ord, score, crossed from st")
def continued_scores(spark, sf):  # noqa: ANN001, ANN201
    """Scores of two runs, the second from a snapshot of the first: those of one run."""
    at, before, after = _halves(spark, sf)
    rows = Q._hits(spark, sf).withColumn("w", F.lit(1).cast("long"))
    first = C.event_scores(before(rows), DAY, 5)
    live = C.live_hits(rows, first.where("crossed"), DAY, at).select("bucket", F.col("key").cast("string").alias("key"), "us", "ord", "w", F.lit(None).cast("string").alias("of"))
    seed = _left_over(spark, at, hits=live).hits
    return first.unionByName(C.event_scores(after(rows), DAY, 5, seed=seed)).select("key", "us", "ord", "score", "crossed")


@Q.query(Q.ORACLES["distinct_score"])
def continued_distinct(spark, sf):  # noqa: ANN001, ANN201
    at, before, after = _halves(spark, sf)
    rows = Q._hits(spark, sf).withColumn("of", Q._seldom((F.col("k") % 10).cast("string")))
    first = C.distinct_scores(before(rows), 2 * DAY, 4)
    live = C.live_hits(rows, first.where("crossed"), 2 * DAY, at).select("bucket", F.col("key").cast("string").alias("key"), "us", "ord", "w", "of")
    return first.unionByName(C.distinct_scores(after(rows), 2 * DAY, 4, seed=_left_over(spark, at, hits=live).hits)).drop("bucket")


@Q.query(Q.ORACLES["subnet_score"])
def continued_subnets(spark, sf):  # noqa: ANN001, ANN201
    at, before, after = _halves(spark, sf)
    rows = hits(spark, sf).select("bucket", Q._mixed("ip", "event_id").alias("key"), "us", "ord", "w")
    first = C.subnet_crossings(before(rows), 24, DAY, 30, prefix_v6=48)
    live = C.live_hits(C.subnet_deposits(rows, 24, 48), first.withColumnRenamed("cidr", "key"), DAY, at)
    second = C.subnet_crossings(after(rows), 24, DAY, 30, prefix_v6=48, seed=_left_over(spark, at, deposits=live).deposits)
    return first.unionByName(second).drop("bucket").withColumn("members", F.array_join("members", ","))


@Q.query(Q._LIVE + "select id, name, value, first_set, expires from live")
def continued_marks(spark, sf):  # noqa: ANN001, ANN201
    at, before, after = _halves(spark, sf)
    probes, events = Q._probes(spark, sf), Q._marks(spark, sf)
    live = K.live_marks(events, at).withColumn("key", F.col("key").cast("string"))
    seed = _left_over(spark, at, marks=live).marks
    return K.as_of_marks(before(probes), before(events)).unionByName(K.as_of_marks(after(probes), K.with_marks(after(events), seed)))


@Q.query(Q.TRACK_SQL + "select event_id, live_before, before_addr, after_addr from r")
def continued_tracks(spark, sf):  # noqa: ANN001, ANN201
    at, before, after = _halves(spark, sf)
    rows = Q._track_rows(spark, sf)
    live = K.live_tracks(rows, ["addr"], DAY, at).select(F.lit("session").alias("name"), F.col("key").cast("string").alias("key"), "expires", F.create_map(F.lit("addr"), F.col("addr")).alias("fields"))
    seed = _left_over(spark, at, tracks=live).tracks.withColumn("addr", F.col("fields")["addr"])
    both = K.tracks(before(rows), ["addr"], DAY).unionByName(K.tracks(after(rows), ["addr"], DAY, seed))
    return both.select("event_id", "live_before", "before_addr", "after_addr")


@Q.query(SQL + """select case when event_id % 17 = 0 then null else event_type end as daemon, case when event_id % 17 <> 0 and k % 10 < 8 then k % 10 end as severity, count(*) as n from h group by all""")
def journal_files(spark, sf):  # noqa: ANN001, ANN201
    """read_journal_export: records as journalctl writes them, and lines that are none."""
    place = shared_path(spark, "journal")
    hits(spark, sf).selectExpr(f"{LINES['journal']} as line").write.text(place)
    return logs.read_journal_export(spark, place).groupBy(F.col("record.daemon").alias("daemon"), F.col("record.severity").alias("severity")).agg(F.count("*").alias("n"))


@Q.query(SQL + """select event_id from h where ip in (select ip from h where event_type = 'error' and k % 50 = 0)""")
def blocklist_files(spark, sf):  # noqa: ANN001, ANN201
    """read_blocklist of feed files with comments and blanks, into blocklist_gate."""
    place, rows = shared_path(spark, "feed"), hits(spark, sf)
    entry = F.concat(F.lit("  "), "ip", F.when(F.col("k") % 3 == 0, "/32 # seen ").otherwise("  "), "event_type")
    entry = F.when(F.col("k") % 3 == 0, entry).otherwise(F.concat(F.lit("\t"), "ip", F.lit("#")))
    listed = F.when((F.col("event_type") == "error") & (F.col("k") % 50 == 0), entry).otherwise(F.when(F.col("k") % 2 == 0, F.concat(F.lit("# "), "ip")).otherwise("   "))
    rows.select(listed.alias("value")).write.text(place)
    return G.blocklist_gate(rows, [("ip", [logs.read_blocklist(spark, place)], "cidr")]).select("event_id")
