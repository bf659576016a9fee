"""Reports over the ban ledger and the event stream."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}


def span_seconds(text: str) -> int:
    """``7d`` or plain seconds."""
    m = re.fullmatch(r"(\d+)([smhdw]?)", text.strip())
    if not m:
        raise ValueError(f"no span: {text!r}")
    return int(m[1]) * SPAN[m[2] or "s"]


def ledger_query(ledger: DataFrame, kur: str | None = None, ip: str | None = None, since: int | str | None = None, now: int = 0, tail: int | None = None) -> DataFrame:
    """Ledger rows by kur, address and age (an epoch, or a span before ``now``), then the last ``tail`` in order."""
    out = ledger
    if kur is not None:
        out = out.where(F.col("kur") == kur)
    if ip is not None:
        out = out.where(F.col("ip") == ip)
    if since is not None:
        begin = since if isinstance(since, int) else int(since) if since.isdigit() and len(since) > 8 else now - span_seconds(since)
        out = out.where(F.col("epoch") >= begin)
    return out if tail is None else out.orderBy(F.desc("epoch"), F.desc("ord")).limit(tail)


def busiest_offenders(events: DataFrame, k: int = 10) -> DataFrame:
    """The k addresses with most found and banish events; equal counts by address."""
    who = F.coalesce(F.col("src"), F.col("host")).alias("offender")
    return events.where(F.col("event_type").isin("found", "banish")).groupBy(who).agg(F.count("*").alias("n")).where("offender is not null").orderBy(F.desc("n"), "offender").limit(k)


def distinct_subjects(events: DataFrame, event_type: str, cols: list[str]) -> DataFrame:
    """banishments ('banish'), would-have-banned ('alert') or sighted subjects ('sighted')."""
    return events.where(F.col("event_type") == event_type).select(cols).distinct()


def offender_history(events: DataFrame, ip: str) -> DataFrame:
    return events.where((F.col("src") == ip) | (F.col("ip") == ip))


def closest_to_ban(events: DataFrame) -> DataFrame:
    """(ip, score, threshold, ratio) of found events, each once."""
    return events.where("event_type = 'found'").select("ip", "score", "threshold").distinct().withColumn("ratio", F.col("score") / F.col("threshold"))


def active_bans(ledger: DataFrame, as_of: int, default_ban_time: int) -> DataFrame:
    """(kur, ip, expires) of who is held; ban_time 0 is forever (expires null), a null one takes the default."""
    time = F.coalesce("ban_time", F.lit(default_ban_time))
    rows = ledger.where(F.col("epoch") <= as_of).select("kur", "ip", (time == 0).alias("forever"), (F.col("epoch") + time).alias("until"))
    held = rows.groupBy("kur", "ip").agg(F.bool_or("forever").alias("forever"), F.max("until").alias("until"))
    return held.where(F.col("forever") | (F.col("until") > as_of)).select("kur", "ip", F.when(~F.col("forever"), F.col("until")).alias("expires"))


def ban_tally(held: DataFrame, members: DataFrame) -> DataFrame:
    """(kur, banned): addresses held per kur; a gate kur counts the union of its members' addresses; '' is the sum of kurs.

    ``members``: (gate, kur)."""
    own = held.groupBy("kur").agg(F.count_distinct("ip").alias("banned"))
    gates = held.join(members, "kur").groupBy(F.col("gate").alias("kur")).agg(F.count_distinct("ip").alias("banned"))
    each = own.join(gates.select("kur"), "kur", "left_anti").unionByName(gates)
    return each.unionByName(own.agg(F.lit("").alias("kur"), F.coalesce(F.sum("banned"), F.lit(0)).alias("banned")))


def stats(lines: DataFrame) -> DataFrame:
    """Counters in all, by watcher and by rule, of records (watcher, rule, parsed, matched, ignored, event_type), and where
    these columns are there: n_lines (lines of the record), demoted, subnet_ban (its network crossed), recidivist (its
    ban escalated)."""
    is_type = lambda *t: F.count_if(F.col("event_type").isin(*t))
    sums = {
        "lines": F.count("*"), "unparsed": F.count_if(~F.col("parsed")), "matched": F.count_if("matched"), "ignored": F.count_if("ignored"),
        "bans": is_type("banish"), "alerts": is_type("alert"), "sightings": is_type("sighting", "sighted"), "noted": is_type("noted"),
    }
    more = {"joined": ("n_lines", F.count_if(F.col("n_lines") > 1)), "demoted": ("demoted", F.count_if("demoted")), "subnet_bans": ("subnet_ban", F.count_if("subnet_ban")), "recidivists": ("recidivist", F.count_if("recidivist"))}
    sums |= {n: c for n, (column, c) in more.items() if column in lines.columns}
    return lines.groupingSets([[], [F.col("watcher")], [F.col("rule")]], "watcher", "rule").agg(F.grouping_id().cast("int").alias("level"), *(c.alias(n) for n, c in sums.items()))
