"""What the registered queries read: the driver's tables as hits and as log lines of every format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import micros
from ..sources.tables import read_table

DAY = 86_400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hits(spark: SparkSession, sf: str, read: Callable[[SparkSession, str, str], DataFrame] = table) -> DataFrame:
    """One hit for each event: address, weight, rule, order and clock parts."""
    ev = read(spark, sf, "events").select("event_id", micros().alias("us"), "user_id", "event_type", F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int").alias("k"))
    return ev.selectExpr(
        "*", "event_id as ord", "'kur:web' as bucket", "concat('10.', user_id % 4, '.', k % 8, '.', user_id % 50 + 1) as ip",
        "case event_type when 'error' then 3L when 'purchase' then 2L else 1L end as w", "cast(us div 1000000 as long) as sec",
        "cast(1 + us div 86400000000 % 28 as int) as dd", "cast(us div 3600000000 % 24 as int) as hh", "cast(us div 60000000 % 60 as int) as mi", "cast(us div 1000000 % 60 as int) as ss",
    )


#: The same in DuckDB, as the first of a query's common table expressions.
SQL = r"""
with ev as (select event_id, epoch_us(ts) as us, user_id, event_type, regexp_extract(props, '"k": *(\d+)', 1)::int as k from events),
h as (select *, event_id as ord, 'kur:web' as bucket, concat('10.', user_id % 4, '.', k % 8, '.', user_id % 50 + 1) as ip,
             case event_type when 'error' then 3::bigint when 'purchase' then 2 else 1 end as w, us // 1000000 as sec,
             (1 + us // 86400000000 % 28)::int as dd, (us // 3600000000 % 24)::int as hh, (us // 60000000 % 60)::int as mi, (us // 1000000 % 60)::int as ss from ev)
"""
_CLOCK = "lpad(cast(hh as string), 2, '0'), ':', lpad(cast(mi as string), 2, '0'), ':', lpad(cast(ss as string), 2, '0')"


def _line(text: str) -> str:
    return f"case when event_id % 17 = 0 then concat('?? no line of this kind: ', event_type) else {text} end"


#: Log lines as text that both engines read alike; each 17th fits no parser.
LINES = {
    "bsd": _line(f"concat('<', k * 2, '>Jan ', lpad(cast(dd as string), 2, ' '), ' ', {_CLOCK}, ' host', user_id % 5, ' ', event_type, '[', user_id, ']: value ', k, ' from ', ip)"),
    "ietf": _line(f"concat('<', k, '>1 2024-01-', lpad(cast(dd as string), 2, '0'), 'T', {_CLOCK}, 'Z host', user_id % 5, ' ', event_type, ' ', case when k % 3 = 0 then '-' else cast(user_id as string) end, ' ID1 [a b=\"c ]d\"] value ', k, ' from ', ip)"),
    "json_syslog": _line("""concat('{"message": "value ', k, '", "Host": "host', user_id % 5, '", "PROGRAM": "', event_type, '", "pid": "", "PRIORITY": "', case when k % 2 = 0 then 'err' else 'info' end, '", "DATE": "d', dd, '", "FACILITY_NUM": "', k % 24, '"}')"""),
    "journal": _line("""concat('{"MESSAGE": "value ', k, '", "_COMM": "', event_type, '", "_PID": "', user_id, '", "PRIORITY": "', k % 10, '", "__REALTIME_TIMESTAMP": "', us, '", "_HOSTNAME": [104, 105]}')"""),
    "access": _line(f"""concat(ip, ' - ', case when k % 2 = 0 then '-' else concat('u', user_id) end, ' [', dd, '/Jan/2024:', {_CLOCK}, ' +0000] "', case when k % 5 = 0 then 'junk' else concat('GET /', event_type, '?k=', k, ' HTTP/1.1') end, '" ', 200 + k, ' ', case when k % 7 = 0 then '-' else cast(k as string) end, case when k % 3 = 0 then '' else concat(' "-" "agent ', k, '"') end)"""),
    "apache": _line(f"""concat('[Mon Jan ', lpad(cast(dd as string), 2, '0'), ' ', {_CLOCK}, '.123456 2024] [', case when k % 4 = 0 then '' else 'core:' end, 'error] [pid ', user_id, '] [client ', ip, ':', 1000 + k, '] ', case when k % 2 = 0 then 'AH00124: ' else '' end, 'value ', k)"""),
    "nginx": _line(f"""concat('2024/01/', lpad(cast(dd as string), 2, '0'), ' ', {_CLOCK}, ' [error] ', user_id, '#0: *', k, ' open failed, client: forged, client: ', ip, ', server: s', user_id % 5, ', request: "GET /', event_type, ', x HTTP/1.1"', case when k % 2 = 0 then ', host: "h"' else '' end)"""),
    "json": _line("""concat('{"type": "', event_type, '", "src": {"ip": "', ip, '", "ok": true}, "tags": ["a", ', k, '], "none": null}')"""),
    "pairs": _line("""concat('action=', event_type, ' user="x srcip=6.6.6.6 y" srcip=', ip, ' srcip=7.7.7.7 n=', k)"""),
}


def dealt(spark: SparkSession, sf: str) -> DataFrame:
    """The hits for work that costs much a row: a small table is spread over all cores first."""
    return hits(spark, sf, lambda spark, sf, name: read_table(spark, f"{sf}/{name}.parquet"))


def lines(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """The hits as lines, for parsing and matching."""
    return dealt(spark, sf).selectExpr("*", f"{LINES[kind]} as line")
