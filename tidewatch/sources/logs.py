"""Sources and sinks: log lines, events, the ban ledger, block lists, state snapshots."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parse import flatten_json, parse_journal

LEDGER = "epoch long, kur string, ip string, rule string, watcher string"


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, source, seq) of text files; globs are the reader's.

    ``seq`` (block, row) orders the lines of a source as they stand in the file: ``block`` is where a task's piece of the file
    begins, ``row`` grows within it. It takes no shuffle, and sorts alike however the file is split.
    """
    return _lines_of(spark.read.text(paths))


def _lines_of(text: DataFrame) -> DataFrame:
    seq = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"), seq.alias("seq"))


def read_log_offsets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, source, seq, at, until) of files whose lines end with a line feed: the bytes of the file in which a line stands,
    its end included. The last line counts as ended. Null lines there are none; a carriage return before the end is cut off.

    Sums within a piece of a file are windows of at most ``spark.sql.files.maxPartitionBytes``; the pieces add one row each.
    """
    rows = _lines_of(spark.read.option("lineSep", "\n").text(paths)).withColumns({"_block": F.col("seq.block"), "_size": F.octet_length("line") + F.lit(1).cast("long")})
    pieces = rows.groupBy("source", "_block").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("source", "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(pieces, ["source", "_block"]).withColumn("until", F.col("_base") + F.sum("_size").over(inside))
    return placed.select(F.regexp_replace("line", "\r\\z", "").alias("line"), "source", "seq", (F.col("until") - F.col("_size")).alias("at"), "until")


def read_logs_after(spark: SparkSession, paths: str | list[str], ends: DataFrame) -> DataFrame:
    """As ``read_log_offsets``, but only lines from where an earlier run stopped: ``ends`` (source, until). A source that is not
    among them is new and read whole; one that has become shorter was begun anew and is read whole too."""
    rows = read_log_offsets(spark, paths)
    size = F.max("until").alias("_size")
    known = rows.groupBy("source").agg(size).join(ends.groupBy("source").agg(F.max("until").alias("_end")), "source", "left")
    begin = known.select("source", F.when(F.col("_end") <= F.col("_size"), F.col("_end")).otherwise(F.lit(0)).alias("_begin"))
    return rows.join(begin, "source").where(F.col("at") >= F.coalesce("_begin", F.lit(0))).drop("_begin")


def stream_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"))


def read_ndjson_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(line, source, raw variant, fields map); a line that isn't one JSON object has both null, and counts as unparsed."""
    lines = read_logs(spark, paths)
    fields = flatten_json(F.col("line"))
    return lines.withColumn("fields", fields).withColumn("raw", F.when(F.col("fields").isNotNull(), F.try_parse_json("line")))


def read_journal_export(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_logs(spark, paths).withColumn("record", parse_journal(F.col("line")))


def read_blocklist(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of a feed: comments cut off, trimmed, blanks skipped."""
    entry = F.regexp_replace("value", r"#.*$|^\s+|\s+(?=#|$)", "")
    return spark.read.text(paths).select(entry.alias("entry")).where("entry <> ''").distinct()


def read_ledger(spark: SparkSession, paths: str | list[str], since: int | None = None) -> DataFrame:
    """Ledger rows of CSV files; old rows of three columns have null rule and watcher, mangled ones are skipped.

    With ``since`` only rows from that epoch on; files under earlier dates aren't read."""
    reader = spark.read.schema(LEDGER.replace("epoch long", "epoch string")).option("recursiveFileLookup", "true")
    raw = reader.csv(paths, quote='"', escape='"', mode="PERMISSIVE")
    if since is not None:
        date = F.regexp_extract("_metadata.file_path", r"/date=(\d{4}-\d\d-\d\d)/", 1)
        raw = raw.where((date == "") | (date >= F.date_format(F.timestamp_seconds(F.lit(since)), "yyyy-MM-dd")))
    rows = raw.withColumn("epoch", F.col("epoch").try_cast("long")).where("epoch is not null and kur is not null and ip is not null")
    return rows if since is None else rows.where(F.col("epoch") >= since)


def append_ledger(bans: DataFrame, path: str) -> None:
    """Append ban rows under the date of their epoch; line breaks are removed from their texts."""
    clean = lambda c: F.regexp_replace(c, r"[\r\n]", "")
    rows = bans.select("epoch", *(clean(c).alias(c) for c in ("kur", "ip", "rule", "watcher")), F.to_date(F.timestamp_seconds("epoch")).alias("date"))
    rows.write.mode("append").partitionBy("date").csv(path, quote='"', escape='"')


def kept_ledger(ledger: DataFrame, now: int, keep: int = 30 * 86_400, recidive_find_time: int = 604_800) -> DataFrame:
    """Rows younger than the longer of both spans; ``keep`` 0 keeps all."""
    return ledger if keep == 0 else ledger.where(now - F.col("epoch") < max(keep, recidive_find_time))


def compact_ledger(spark: SparkSession, path: str, to: str, now: int, keep: int = 30 * 86_400, recidive_find_time: int = 604_800) -> None:
    """Write the rows of the ledger at ``path`` that are to be kept to ``to``, in one file for each date.

    A ledger that a job reads can't be overwritten by it: the caller puts the new folder in the old one's place."""
    kept = kept_ledger(read_ledger(spark, path), now, keep, recidive_find_time)
    append_ledger(kept.repartition(F.to_date(F.timestamp_seconds("epoch"))), to)


def write_events(events: DataFrame, path: str) -> None:
    """NDJSON by event type; absent fields are left out, but for src_ip and dest_ip. Each task's rows of a type are a file."""
    line = _json(events)
    events.select(F.col("event_type"), line.alias("value")).write.mode("append").partitionBy("event_type").text(path)


def _json(events: DataFrame) -> Column:
    ends = [c for c in ("src_ip", "dest_ip") if c in events.columns]
    rest = F.to_json(F.struct(*(F.col(c) for c in events.columns if c not in ends)))
    if not ends:
        return rest
    always = F.to_json(F.struct(*ends), {"ignoreNullFields": "false"})
    return F.when(rest == "{}", always).otherwise(F.concat(F.substring(rest, F.lit(1), F.char_length(rest) - 1), F.lit(","), F.substring(always, 2, 1 << 30)))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("e")).select("e.*")


STATE = (
    "family string, name string, key string, us long, ord long, w long, value string, expires long, first_set long, member string, fields map<string,string>"
)


def snapshot_state(path: str, hits: DataFrame, marks: DataFrame, tracks: DataFrame | None = None, deposits: DataFrame | None = None) -> None:
    """Live state as one table, for the next run to begin with.

    hits (bucket, key, us, ord, w, of), which hold distinct values too; marks (name, key, value, expires, first_set);
    tracks (name, key, expires, fields map); deposits on networks (bucket, key: the network, us, ord, w, member).
    """
    kinds = [x.split(" ") for x in STATE.split(", ")[1:]]

    def rows(family: str, df: DataFrame, named: dict[str, str]) -> DataFrame:
        cols = [(F.col(named.get(n, n)) if named.get(n, n) in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in kinds]
        return df.select(F.lit(family).alias("family"), *cols)

    parts = [rows("hit", hits, {"name": "bucket", "value": "of"}), rows("mark", marks, {})]
    parts += [rows("track", tracks, {})] if tracks is not None else []
    parts += [rows("subnet", deposits, {"name": "bucket"})] if deposits is not None else []
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").partitionBy("family").parquet(path)


@dataclass
class State:
    hits: DataFrame
    marks: DataFrame
    tracks: DataFrame
    deposits: DataFrame


def seed_state(spark: SparkSession, path: str, now: int, idle: int = 86_400) -> State:
    """What a snapshot leaves for the next run: keys and networks idle for longer than ``idle`` seconds are dropped, a missing
    weight is 1, expired marks and tracks are dropped."""
    rows = spark.read.schema(STATE).parquet(path)
    of = lambda family: rows.where(F.col("family") == family)
    newest = F.max("us").over(Window.partitionBy("bucket", "key"))
    awake = lambda df: df.withColumn("_newest", newest).where(now - F.col("_newest") <= idle * 1_000_000).drop("_newest")
    weighed = [F.col("name").alias("bucket"), "key", "us", "ord", F.coalesce("w", F.lit(1)).alias("w")]
    live = lambda family: of(family).where(F.col("expires") > now)
    return State(
        hits=awake(of("hit").select(*weighed, F.col("value").alias("of"))),
        marks=live("mark").select("name", "key", "value", "expires", "first_set"),
        tracks=live("track").select("name", "key", "expires", "fields"),
        deposits=awake(of("subnet").select(*weighed, "member")),
    )
