"""Log line parsers: each takes a string column and returns a struct column, null where the line does not fit.

A line is matched once: the replacement writes its groups with separators, and the parts become fields; what a line ends
with, whatever it is, is not gone through. Lines that hold the separators take others, and those that hold all of them are matched
group by group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYSLOG = ("format", "time", "hostname", "daemon", "pid", "facility", "severity", "level", "message")

# RFC 5424 facility and severity names, in the order of their numbers.
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
SEVERITIES = "emerg alert crit err warning notice info debug".split()
SEVERITY_ALIASES = {"panic": 0, "error": 3, "warn": 4}

#: What begins a line's groups, and what stands before each: the first pair that can't be taken for the line's own.
_SEPARATORS = (("\x1e", "\x1f"), ("\x01", "\x02"))
_HIT, _GROUP = _SEPARATORS[0]

#: What stands between quotes, with escapes. Written out and possessive: a loop over alternatives costs the regex engine a stack
#: frame for each round, and a line can be as long as its sender likes. A run of plain characters is greedy inside of that, which
#: the engine goes through in one loop, and a possessive one isn't.
QUOTED = r'(?>[^"\\]*)(?:\\.[^"\\]*)*+'


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def octets(text: Column, begin: Column | int, n: Column | int = 1 << 30) -> Column:
    """Part of a text by bytes, of which the first is 1; no character is counted for it."""
    as_column = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.substring(text.cast("binary"), as_column(begin), as_column(n)).cast("string")


_REST = "(.*)"
_given = lambda c: F.nullif(c, F.lit(""))


def parts(line: Column, pattern: str, names: list[str]) -> Column:
    """Struct of the pattern's groups in order (empty and absent ones null), or null.

    One pass over the line writes its groups with separators before them; a group that takes all the rest of the line is left as it
    is. A line that holds separators of its own could forge groups so: then there are too many parts, and it takes the next
    separators; one that holds all has its groups extracted one by one."""
    whole, count = f"(?s)^{pattern}$", len(names)
    rest = pattern.endswith(_REST)
    begin = whole.removesuffix(f"{_REST}$") if rest else whole
    fields = lambda of: F.struct(*(of(k).alias(n) for k, n in enumerate(names)))

    def attempt(pairs: tuple) -> Column:
        if not pairs:
            return F.when(line.rlike(whole), fields(lambda k: let(F.regexp_extract(line, whole, k + 1), _given)))
        hit, group = pairs[0]
        written = F.regexp_replace(line, F.lit(begin), F.lit(hit + "".join(f"{group}${k + 1}" for k in range(count - rest)) + group * rest))

        def read(f: Column) -> Column:
            fits = F.get(f, F.lit(0)) == hit
            return F.when(f.isNull() | (fits & (F.size(f) != count + 1)), attempt(pairs[1:])).when(fits, fields(lambda k: _given(F.element_at(f, k + 2))))

        return let(F.when(~F.startswith(line, F.lit(hit)), F.split(written, group, -1)), read)

    return attempt(_SEPARATORS)


def found_parts(text: Column, pattern: str, names: list[str]) -> Column:
    """The same of the first match of a pattern without choices at its top, whatever stands before and after it."""
    count = len(names)
    written = F.regexp_replace(text, F.lit(f"{pattern}(?s:.*)"), F.lit("".join(f"{_GROUP}${k + 1}" for k in range(count))))

    def read(f: Column) -> Column:
        fields = F.struct(*(_given(F.element_at(f, k + 2)).alias(n) for k, n in enumerate(names)))
        slow = parts(text, f"(?s:.*?)(?-s:{pattern})(?s:.*)", names)
        return F.when(f.isNull() | ~F.size(f).isin(1, count + 1), slow).when(F.size(f) == count + 1, fields)

    return let(F.when(~F.contains(text, F.lit(_GROUP)), F.split(written, _GROUP, -1)), read)


def _known(names: list[str], aliases: dict[str, int] | None = None) -> Column:
    pairs = [(n, k) for k, n in enumerate(names)] + list((aliases or {}).items())
    return F.create_map(*(F.lit(x) for p in pairs for x in p))


def severity_number(name: Column) -> Column:
    """0 to 7 for a severity name or alias in any case, else null."""
    return F.try_element_at(_known(SEVERITIES, SEVERITY_ALIASES), F.lower(name))


def severity_name(number: Column) -> Column:
    return F.when(number.between(0, 7), F.element_at(F.array(*map(F.lit, SEVERITIES)), (number + 1).cast("int")))


def pri_decompose(pri: Column) -> Column:
    """(facility name, severity number, level name) of a PRI value; null above 191."""
    pri = pri.cast("int")
    facility = F.element_at(F.array(*map(F.lit, FACILITIES)), F.floor(pri / 8).cast("int") + 1)
    return F.when(pri.between(0, 191), F.struct(facility.alias("facility"), (pri % 8).alias("severity"), severity_name(pri % 8).alias("level")))


def _syslog(fmt: str, x: Column, time: Column, host: Column, daemon: Column, pid: Column, facility: Column, severity: Column, message: Column) -> Column:
    severity = severity.cast("int")
    fields = (F.lit(fmt), time, host, daemon, pid, facility, severity, severity_name(severity), message)
    return F.when(x, F.struct(*(c.alias(n) for c, n in zip(fields, SYSLOG, strict=True))))


_BSD = (
    r"(?:<(?:(\d{1,3})|(\w+)\.(\w+))>)?"
    r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d{1,2} \d\d:\d\d:\d\d|\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\S*) "
    r"(?:<(?:(\d{1,3})|(\w+)\.(\w+))> )?"
    r"(?:([^\s:\[\]<>]+|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*[0-9A-Fa-f]) )?"
    r"([^\s:\[\]]+)(?:\[(\d+)(?::\d+)?\])?: ?(.*)"
)


def parse_bsd_syslog(line: Column) -> Column:
    """RFC 3164, with or without PRI, host and pid; ``<facility.level>`` wins over PRI; PRI above 191 does not fit."""
    return let(parts(line, _BSD, ["pri", "fac", "lev", "time", "pri2", "fac2", "lev2", "host", "daemon", "pid", "message"]), _bsd_record)


def _bsd_record(x: Column) -> Column:
    pri = F.coalesce(x["pri"], x["pri2"])
    of = pri_decompose(pri)
    facility, severity = F.coalesce(x["fac"], x["fac2"], of["facility"]), F.coalesce(severity_number(F.coalesce(x["lev"], x["lev2"])), of["severity"])
    fits = x.isNotNull() & (pri.isNull() | of.isNotNull())
    return _syslog("bsd", fits, x["time"], x["host"], x["daemon"], x["pid"], facility, severity, F.coalesce(x["message"], F.lit("")))


_ELEMENT = rf'\[(?>[^\]\\"]*)(?:(?:\\.|"{QUOTED}")[^\]\\"]*)*+\]'
_IETF = rf"<(\d{{1,3}})>\d{{1,2}} (\S+) (\S+) (\S+) (\S+) \S+ (?:-|(?:{_ELEMENT})++)(?: |$)(.*)"


def parse_ietf_syslog(line: Column) -> Column:
    """RFC 5424: ``-`` is null, structured data is skipped, an absent message is empty."""
    return let(parts(line, _IETF, ["pri", "time", "host", "daemon", "pid", "message"]), _ietf_record)


def _ietf_record(x: Column) -> Column:
    nil = lambda c: F.nullif(c, F.lit("-"))
    of = pri_decompose(x["pri"])
    message = F.coalesce(F.regexp_replace(x["message"], "^\ufeff", ""), F.lit(""))
    return _syslog("ietf", of.isNotNull(), nil(x["time"]), nil(x["host"]), nil(x["daemon"]), nil(x["pid"]), of["facility"], of["severity"], message)


def json_fields(line: Column) -> Column:
    """map<string,string> of a JSON object's own fields (null values absent), or null."""
    fields = F.from_json(F.when(F.ltrim(line).startswith("{"), line), "map<string,string>")
    return F.map_filter(fields, lambda k, v: v.isNotNull())


def parse_json_syslog(line: Column) -> Column:
    """syslog-ng JSON: key case is folded, '' is absent but for MESSAGE, LEVEL_NUM before PRIORITY, ISODATE before DATE."""
    return let(F.transform_keys(json_fields(line), lambda k, v: F.upper(k)), _json_record)


def _json_record(m: Column) -> Column:
    get = lambda k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    priority = get("PRIORITY")
    severity = F.coalesce(get("LEVEL_NUM").try_cast("int"), F.when(priority.rlike("^[0-7]$"), priority.try_cast("int")), severity_number(priority), severity_number(get("LEVEL")))
    number = get("FACILITY_NUM").try_cast("int")
    facility = F.coalesce(get("FACILITY"), F.when(number.between(0, 23), F.element_at(F.array(*map(F.lit, FACILITIES)), number + 1)))
    message = F.try_element_at(m, F.lit("MESSAGE"))
    return _syslog("json_syslog", message.isNotNull(), F.coalesce(get("ISODATE"), get("DATE")), get("HOST"), get("PROGRAM"), get("PID"), facility, F.when(severity.between(0, 7), severity), message)


def _journal_text(v: Column) -> Column:
    """A value that journalctl writes as an array of bytes becomes text again."""
    codes = F.from_json(F.when(v.startswith("["), v), "array<int>")
    return F.coalesce(F.array_join(F.transform(codes, lambda c: F.char(c.cast("long"))), ""), v)


def parse_journal(line: Column) -> Column:
    """journalctl -o json: MESSAGE is required, SYSLOG_IDENTIFIER before _COMM, _PID before SYSLOG_PID."""
    return let(json_fields(line), _journal_record)


def _journal_record(m: Column) -> Column:
    get = lambda k: _journal_text(F.try_element_at(m, F.lit(k)))
    severity = F.when(get("PRIORITY").rlike("^[0-7]$"), get("PRIORITY").try_cast("int"))
    number = get("SYSLOG_FACILITY").try_cast("int")
    facility = F.when(number.between(0, 23), F.element_at(F.array(*map(F.lit, FACILITIES)), number + 1))
    return _syslog("journal", get("MESSAGE").isNotNull(), get("__REALTIME_TIMESTAMP"), get("_HOSTNAME"), F.coalesce(get("SYSLOG_IDENTIFIER"), get("_COMM")), F.coalesce(get("_PID"), get("SYSLOG_PID")), facility, severity, get("MESSAGE"))


def parse_syslog_any(line: Column) -> Column:
    """The shape of the line's beginning tells which syslog parser is tried first."""
    bsd, ietf, json = parse_bsd_syslog(line), parse_ietf_syslog(line), parse_json_syslog(line)
    return F.when(F.ltrim(line).startswith("{"), F.coalesce(json, bsd, ietf)).when(line.rlike(r"^<\d{1,3}>\d"), F.coalesce(ietf, bsd, json)).otherwise(F.coalesce(bsd, ietf, json))


_ACCESS = rf"""\s*(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"({QUOTED})"\s+(\d{{3}})\s+(\d+|-)(?:\s+"({QUOTED})"\s+"({QUOTED})")?\s*"""


def parse_http_access(line: Column) -> Column:
    """Common and combined access logs; a request that isn't one has null method, path and protocol; ``-`` is null. A line with
    anything else after its last field is none."""
    x = parts(line, _ACCESS, ["host", "ident", "user", "time", "request", "status", "bytes", "referer", "agent"])
    request = lambda x: parts(F.coalesce(x["request"], F.lit("")), r"([A-Za-z]+) (\S+)(?: (HTTP/\S+))?", ["method", "path", "protocol"])
    return let(x, lambda x: let(request(x), lambda r: _access_record(x, r)))


def _access_record(x: Column, r: Column) -> Column:
    nil = lambda c: F.nullif(c, F.lit("-"))
    fmt = F.when(x["agent"].isNotNull() | x["referer"].isNotNull(), "combined").otherwise("clf")
    fields = {
        "format": fmt, "host": x["host"], "ident": nil(x["ident"]), "user": nil(x["user"]), "time": x["time"], "request": F.coalesce(x["request"], F.lit("")),
        "method": r["method"], "path": r["path"], "protocol": r["protocol"], "status": x["status"], "bytes": nil(x["bytes"]), "referer": nil(x["referer"]), "user_agent": nil(x["agent"]),
    }
    return F.when(x.isNotNull(), F.struct(*(c.alias(n) for n, c in fields.items())))


_APACHE = (
    r"\[([A-Z][a-z]{2} [A-Z][a-z]{2} +\d{1,2} [0-9:.]+ \d{4})\] \[(?:([^\]:]*):)?([a-z]+[0-9]?)\] (?:\[pid (\d+)(?::tid (\d+))?\] )?"
    r"(?:\[client ([^\]]+?)\] )?(?:(AH\d{5}): )?(.*)"
)


def parse_apache_error(line: Column) -> Column:
    """2.2 and 2.4 error logs. The client's port is split off where what is left is an IPv4 address or stands in brackets,
    or is an IPv6 address of eight groups."""
    return let(parts(line, _APACHE, ["time", "module", "level", "pid", "tid", "client", "code", "message"]), _apache_record)


def _apache_record(x: Column) -> Column:
    split = r"^(\d{1,3}(?:\.\d{1,3}){3}|\[[0-9A-Fa-f:.]+\]|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}):(\d{1,5})$"
    has = x["client"].rlike(split)
    client = F.when(has, F.translate(F.regexp_extract(x["client"], split, 1), "[]", "")).otherwise(x["client"])
    port = F.when(has, F.regexp_extract(x["client"], split, 2))
    fields = {
        "format": F.lit("apache_error"), "time": x["time"], "module": x["module"], "level": x["level"], "pid": x["pid"], "tid": x["tid"],
        "client": client, "client_port": port, "code": x["code"], "message": F.coalesce(x["message"], F.lit("")),
    }
    return F.when(x.isNotNull(), F.struct(*(c.alias(n) for n, c in fields.items())))


_NGINX = r"(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[([a-z]+)\] (\d+)#(\d+): (?:\*(\d+) )?(.*)"
NGINX_TAIL = ("client", "server", "request", "upstream", "host", "referrer")
# the first letter alone tells most of what isn't one
_NGINX_PAIR = f", (?=[{''.join(sorted({k[0] for k in NGINX_TAIL}))}])(?=(?:{'|'.join(NGINX_TAIL)}): )"


def parse_nginx_error(line: Column) -> Column:
    """nginx error logs: ``, key: value`` pairs are peeled from the right, so that a forged pair further left stays message."""
    x = parts(line, _NGINX, ["time", "level", "pid", "tid", "cid", "message"])
    return let(x, lambda x: let(F.split(x["message"], _NGINX_PAIR, -1), lambda at: let(_peeled(_segments(at), F.size(at)), lambda pairs: _nginx_record(x, at, pairs))))


def _segments(at: Column) -> Column:
    """array<(i, key, bare, opens, quotes, closes)> of a message that is cut before each ``key: ``. bare: the value holds no comma and no
    quote; opens: it begins with a quote; quotes: how many that aren't escaped; closes: it ends with one. i is the place, from 1 on."""

    def described(i: Column, key: Column, value: Column, shape: Column) -> Column:
        return F.struct(
            i.alias("i"), key.alias("key"), ((key != "") & (shape == "") & ~F.contains(value, F.lit(","))).alias("bare"), F.startswith(value, F.lit('"')).alias("opens"),
            (F.char_length(shape) - F.char_length(F.replace(shape, F.lit('"')))).alias("quotes"), F.endswith(shape, F.lit('"')).alias("closes"),
        )

    def segment(text: Column, i: Column) -> Column:
        key = F.when(i > 0, F.substring_index(text, ":", 1)).otherwise("")
        value = lambda key: F.when(key != "", octets(text, F.octet_length(key) + 3)).otherwise("")
        # of a value with quotes those that aren't escaped, and a dash for whatever stands between them
        shape = lambda value: F.when(F.contains(value, F.lit('"')), F.regexp_replace(value, r'(?s)[^"\\]+(?:\\.[^"\\]*)*+|(?:\\.[^"\\]*)++', "-")).otherwise("")
        return let(key, lambda key: let(value(key), lambda value: let(shape(value), lambda shape: described(i + 1, key, value, shape))))

    return F.transform(at, segment)


def _peeled(segments: Column, last: Column) -> Column:
    """struct(from: the first place of the tail, and for each key its last pair's first and last place) of ``last`` segments. One pass from
    the right; a quoted value may go over several segments, and is one where it has two quotes, at its ends."""
    place = "struct<from:int,to:int>"
    start = F.struct(
        (last + 1).alias("from"), last.alias("end"), F.lit(0).alias("quotes"), F.lit(False).alias("closes"), F.lit(False).alias("over"), *(F.lit(None).cast(place).alias(k) for k in NGINX_TAIL),
    )

    def step(acc: Column, x: Column) -> Column:
        quotes, closes = acc["quotes"] + x["quotes"], F.when(acc["end"] == x["i"], x["closes"]).otherwise(acc["closes"])
        # bare ones stand alone; whatever isn't a pair yet waits for what stands before it
        pair = ~acc["over"] & (((acc["end"] == x["i"]) & x["bare"]) | (x["opens"] & closes & (quotes == 2)))

        def taken(k: str) -> Column:
            here = F.struct(x["i"].alias("from"), acc["end"].alias("to"))
            return F.when((x["key"] == k) & acc[k].isNull(), here).otherwise(acc[k])

        found = {"from": x["i"], "end": x["i"] - 1, "quotes": F.lit(0), "closes": F.lit(False), "over": F.lit(False)} | {k: taken(k) for k in NGINX_TAIL}
        other = {"from": acc["from"], "end": acc["end"], "quotes": quotes, "closes": closes, "over": acc["over"] | (x["key"] == "")} | {k: acc[k] for k in NGINX_TAIL}
        row = lambda fields: F.struct(*(c.alias(n) for n, c in fields.items()))
        return F.when(pair, row(found)).otherwise(row(other))

    return F.aggregate(F.reverse(segments), start, step)


def _nginx_record(x: Column, at: Column, pairs: Column) -> Column:
    joined = lambda begin, n: F.array_join(F.slice(at, begin, n), ", ")

    def value(key: str) -> Column:
        text = joined(pairs[key]["from"], pairs[key]["to"] - pairs[key]["from"] + 1)
        # a value that begins with a quote ends with one
        inner = lambda v: F.when(F.startswith(v, F.lit('"')), octets(v, 2, F.octet_length(v) - 2)).otherwise(v)
        return F.when(pairs[key].isNotNull(), let(let(octets(text, len(key) + 3), inner), _given))

    message = joined(F.lit(1), pairs["from"] - 1)
    fields = {"format": F.lit("nginx_error"), "time": x["time"], "level": x["level"], "pid": x["pid"], "tid": x["tid"], "cid": x["cid"], "client": value("client"), "client_port": F.lit(None).cast("string")}
    fields |= {k: value(k) for k in NGINX_TAIL[1:]} | {"message": F.coalesce(message, F.lit(""))}
    return F.when(x.isNotNull(), F.struct(*(c.alias(n) for n, c in fields.items())))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flatten_json(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Dotted paths of a JSON object, ten levels deep: array places are parts, booleans 1 and 0, nulls absent; else null."""
    import json

    def walk(value, path, depth, out):
        if isinstance(value, dict | list):
            if depth >= 10:
                return
            items = value.items() if isinstance(value, dict) else enumerate(value)
            for k, v in items:
                walk(v, f"{path}.{k}" if path else str(k), depth + 1, out)
        elif value is not None:
            out[path] = ("1" if value else "0") if isinstance(value, bool) else value if isinstance(value, str) else json.dumps(value)

    def one(line):
        try:
            value = json.loads(line) if line is not None else None
        except ValueError:
            return None
        if not isinstance(value, dict):
            return None
        out: dict[str, str] = {}
        walk(value, "", 0, out)
        return out

    for batch in lines:
        yield batch.map(one)


def message_json(record: Column) -> Column:
    """Fields of the JSON object that a syslog message holds, with the record's own under ``syslog.``; else null."""
    fields = flatten_json(record["message"])
    own = F.create_map(*(x for n, c in (("daemon", "daemon"), ("host", "hostname"), ("pid", "pid"), ("time", "time"), ("message", "message")) for x in (F.lit(f"syslog.{n}"), record[c])))
    return F.when(fields.isNotNull(), F.map_concat(F.map_filter(fields, lambda k, v: ~F.coalesce(k.startswith("syslog."), F.lit(False))), F.map_filter(own, lambda k, v: v.isNotNull())))


def parse_key_value(message: Column) -> Column:
    """map of ``k=v`` and ``k="v v"`` pairs; the first of a repeated key wins, so a value cannot forge a later one."""
    pairs = F.regexp_extract_all(message, F.lit(rf'(?:^|[\s,])[A-Za-z_][\w.-]*+=(?:"{QUOTED}"|[^\s,"]*+)'), F.lit(0))
    key = lambda pair: F.substring_index(pair, "=", 1)
    bare = lambda v: F.when(F.startswith(v, F.lit('"')), octets(v, 2, F.octet_length(v) - 2)).otherwise(v)
    value = lambda pair, key: let(octets(pair, F.octet_length(key) + 2), bare)
    split = lambda pair: let(key(pair), lambda key: F.struct(key.alias("k"), value(pair, key).alias("v")))
    # a pair may begin with what parts it from the one before
    read = F.transform(pairs, lambda x: let(F.ltrim(x, F.lit(" \t\n\x0b\f\r,")), split))
    # by key, then place: the first of each key is the one that differs from what stands before it
    ordered = F.array_sort(F.transform(read, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v"))))

    def firsts(rows: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.transform(F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))), lambda x: x["k"]))
        marked = F.zip_with(rows, before, lambda x, b: F.struct(x.alias("x"), (x["k"] != b).alias("first")))
        return F.transform(F.filter(marked, lambda m: F.coalesce(m["first"], F.lit(False))), lambda m: F.struct(m["x"]["k"], m["x"]["v"]))

    return F.map_from_entries(let(ordered, firsts))
