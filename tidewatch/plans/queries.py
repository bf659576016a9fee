"""The registered queries of the log operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import predicates as P
from ..functions import scalars as S
from ..functions.ip import ip_family, ip_in_any, ip_network
from ..operators import events as E
from ..operators import gates as G
from ..operators import match as M
from ..operators import reports as R
from ..operators import score as C
from ..operators import stages as ST
from ..operators import state as K
from ..operators.indexed import match_rules_indexed
from ..sources.scratch import written
from .data import DAY, SQL, dealt, hits, lines, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def literal(rows: list[tuple], names: str) -> str:
    return f"(values {', '.join('(' + ', '.join(_sql(x) for x in r) + ')' for r in rows)}) as t({names})"


def _sql(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, list):
        return "[" + ", ".join(map(_sql, x)) + "]"
    return str(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"


def _fields(kind: str, ok: str, cols: dict[str, str]) -> str:
    """Expected fields of a parser, straight from the columns that its lines were made of."""
    return SQL + "select event_id, " + ", ".join(f"case when event_id % 17 <> 0 and {ok} then {e} end as {n}" for n, e in cols.items()) + " from h"


def _parsed(spark: SparkSession, sf: str, kind: str, parser: Callable, names: list[str]) -> DataFrame:
    rows = lines(spark, sf, kind).select("event_id", parser(F.col("line")).alias("r"))
    return rows.select("event_id", *(F.col(f"r.{n}").alias(n) for n in names))


CLOCK = "printf('%02d:%02d:%02d', hh, mi, ss)"
_names = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
FACILITY, LEVEL = _names(parse.FACILITIES), _names(parse.SEVERITIES)
SYSLOG = list(parse.SYSLOG)

# --- parsing


@query(_fields("bsd", "k * 2 <= 191", {
    "format": "'bsd'", "time": f"printf('Jan %2d ', dd) || {CLOCK}", "hostname": "concat('host', user_id % 5)", "daemon": "event_type", "pid": "user_id::varchar",
    "facility": f"({FACILITY})[k * 2 // 8 + 1]", "severity": "k * 2 % 8", "level": f"({LEVEL})[k * 2 % 8 + 1]", "message": "concat('value ', k, ' from ', ip)"}))
def parse_bsd_syslog(spark, sf):  # noqa: ANN001, ANN201
    return _parsed(spark, sf, "bsd", parse.parse_bsd_syslog, SYSLOG)


@query(_fields("ietf", "true", {
    "format": "'ietf'", "time": f"printf('2024-01-%02dT', dd) || {CLOCK} || 'Z'", "hostname": "concat('host', user_id % 5)", "daemon": "event_type", "pid": "case when k % 3 <> 0 then user_id::varchar end",
    "facility": f"({FACILITY})[k // 8 + 1]", "severity": "k % 8", "level": f"({LEVEL})[k % 8 + 1]", "message": "concat('value ', k, ' from ', ip)"}))
def parse_ietf_syslog(spark, sf):  # noqa: ANN001, ANN201
    return _parsed(spark, sf, "ietf", parse.parse_ietf_syslog, SYSLOG)


@query(_fields("json_syslog", "true", {
    "format": "'json_syslog'", "time": "concat('d', dd)", "hostname": "concat('host', user_id % 5)", "daemon": "event_type", "pid": "null::varchar",
    "facility": f"({FACILITY})[k % 24 + 1]", "severity": "case when k % 2 = 0 then 3 else 6 end", "level": "case when k % 2 = 0 then 'err' else 'info' end", "message": "concat('value ', k)"}))
def parse_json_syslog(spark, sf):  # noqa: ANN001, ANN201
    return _parsed(spark, sf, "json_syslog", parse.parse_json_syslog, SYSLOG)


@query(_fields("journal", "true", {
    "format": "'journal'", "time": "us::varchar", "hostname": "'hi'", "daemon": "event_type", "pid": "user_id::varchar", "facility": "null::varchar",
    "severity": "case when k % 10 < 8 then k % 10 end", "level": f"case when k % 10 < 8 then ({LEVEL})[k % 10 + 1] end", "message": "concat('value ', k)"}))
def parse_journal(spark, sf):  # noqa: ANN001, ANN201
    return _parsed(spark, sf, "journal", parse.parse_journal, SYSLOG)


@query(SQL + f"""select event_id, case when event_id % 17 = 0 or (k % 3 = 0 and k * 2 > 191) then null else (['bsd', 'ietf', 'json_syslog'])[k % 3 + 1] end as format,
    case when event_id % 17 = 0 or (k % 3 = 0 and k * 2 > 191) then null else event_type end as daemon,
    case when event_id % 17 = 0 then null when k % 3 = 0 and k * 2 <= 191 then k * 2 % 8 when k % 3 = 1 then k % 8 when k % 3 = 2 then case when k % 2 = 0 then 3 else 6 end end as severity from h""")
def parse_syslog_any(spark, sf):  # noqa: ANN001, ANN201
    from .data import LINES

    mixed = hits(spark, sf).selectExpr("*", f"case k % 3 when 0 then {LINES['bsd']} when 1 then {LINES['ietf']} else {LINES['json_syslog']} end as line")
    rows = mixed.select("event_id", parse.parse_syslog_any(F.col("line")).alias("r"))
    return rows.select("event_id", "r.format", "r.daemon", "r.severity")


@query(_fields("access", "true", {
    "format": "case when k % 3 = 0 then 'clf' else 'combined' end", "host": "ip", "ident": "null::varchar", "user": "case when k % 2 <> 0 then concat('u', user_id) end",
    "time": f"concat(dd, '/Jan/2024:', {CLOCK}, ' +0000')", "request": "case when k % 5 = 0 then 'junk' else concat('GET /', event_type, '?k=', k, ' HTTP/1.1') end",
    "method": "case when k % 5 <> 0 then 'GET' end", "path": "case when k % 5 <> 0 then concat('/', event_type, '?k=', k) end", "protocol": "case when k % 5 <> 0 then 'HTTP/1.1' end",
    "status": "(200 + k)::varchar", "bytes": "case when k % 7 <> 0 then k::varchar end", "referer": "null::varchar", "user_agent": "case when k % 3 <> 0 then concat('agent ', k) end"}))
def parse_http_access(spark, sf):  # noqa: ANN001, ANN201
    return _parsed(spark, sf, "access", parse.parse_http_access, "format host ident user time request method path protocol status bytes referer user_agent".split())


@query(_fields("apache", "true", {
    "time": f"printf('Mon Jan %02d ', dd) || {CLOCK} || '.123456 2024'", "module": "case when k % 4 <> 0 then 'core' end", "level": "'error'", "pid": "user_id::varchar", "tid": "null::varchar",
    "client": "ip", "client_port": "(1000 + k)::varchar", "code": "case when k % 2 = 0 then 'AH00124' end", "message": "concat('value ', k)"}))
def parse_apache_error(spark, sf):  # noqa: ANN001, ANN201
    return _parsed(spark, sf, "apache", parse.parse_apache_error, "time module level pid tid client client_port code message".split())


@query(_fields("nginx", "true", {
    "time": f"printf('2024/01/%02d ', dd) || {CLOCK}", "level": "'error'", "pid": "user_id::varchar", "tid": "'0'", "cid": "k::varchar", "client": "ip", "server": "concat('s', user_id % 5)",
    "request": "concat('GET /', event_type, ', x HTTP/1.1')", "host": "case when k % 2 = 0 then 'h' end", "upstream": "null::varchar", "message": "'open failed'"}))
def parse_nginx_error(spark, sf):  # noqa: ANN001, ANN201
    return _parsed(spark, sf, "nginx", parse.parse_nginx_error, "time level pid tid cid client server request host upstream message".split())


@query(_fields("json", "true", {"type": "event_type", "ip": "ip", "ok": "'1'", "tag0": "'a'", "tag1": "k::varchar", "n": "5"}))
def flatten_json(spark, sf):  # noqa: ANN001, ANN201
    rows = lines(spark, sf, "json").select("event_id", parse.flatten_json("line").alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return rows.select("event_id", get("type").alias("type"), get("src.ip").alias("ip"), get("src.ok").alias("ok"), get("tags.0").alias("tag0"), get("tags.1").alias("tag1"), F.when(F.col("m").isNotNull(), F.size("m")).alias("n"))


@query(SQL + """select event_id, event_type as type, ip, concat('host', user_id % 5) as host, event_type as daemon from h where event_id % 17 <> 0""")
def message_json(spark, sf):  # noqa: ANN001, ANN201
    from .data import LINES

    text = f"concat('<13>Jan ', lpad(cast(dd as string), 2, ' '), ' 00:00:00 host', user_id % 5, ' ', event_type, ': ', {LINES['json']})"
    rows = hits(spark, sf).selectExpr("event_id", f"{text} as line").select("event_id", parse.parse_bsd_syslog(F.col("line")).alias("r"))
    rows = rows.select("event_id", parse.message_json(F.col("r")).alias("m")).where("m is not null")
    get = lambda k, n: F.try_element_at("m", F.lit(k)).alias(n)
    return rows.select("event_id", get("type", "type"), get("src.ip", "ip"), get("syslog.host", "host"), get("syslog.daemon", "daemon"))


@query(_fields("pairs", "true", {"action": "event_type", "srcip": "ip", "user": "'x srcip=6.6.6.6 y'", "n": "k::varchar"}))
def parse_key_value(spark, sf):  # noqa: ANN001, ANN201
    rows = lines(spark, sf, "pairs").select("event_id", parse.parse_key_value(F.col("line")).alias("m"))
    return rows.select("event_id", *(F.try_element_at("m", F.lit(n)).alias(n) for n in ("action", "srcip", "user", "n")))


@query(SQL + f"""select event_id, case when k * 2 <= 191 then ({FACILITY})[k * 2 // 8 + 1] end as facility, case when k * 2 <= 191 then k * 2 % 8 end as severity,
    case when k % 10 < 8 then ({LEVEL})[k % 10 + 1] end as named, case event_type when 'error' then 3 end as numbered from h""")
def pri_and_severity(spark, sf):  # noqa: ANN001, ANN201
    p = parse.pri_decompose(F.col("k") * 2)
    return hits(spark, sf).select("event_id", p["facility"].alias("facility"), p["severity"].alias("severity"), parse.severity_name(F.col("k") % 10).alias("named"), parse.severity_number(F.upper("event_type")).alias("numbered"))


_A, _B = "char(31)", "char(30)"
#: Lines of each format that hold the bytes which the parsers write between groups.
FORGED = {
    "bsd": f"concat('<', k % 24 * 8 + 3, '>Jan  1 00:00:00 ho', {_A}, 'st ', event_type, {_B}, '[', user_id, ']: a', {_A}, k, {_B}, 'b')",
    "ietf": f"concat({_B}, '<13>1 2024-01-01T00:00:00Z ho', {_A}, 'st ', event_type, {_B}, ' ', user_id, ' - - a', {_A}, k, {_B}, 'b')",
    "access": f"concat(ip, ' - - [t] \"GET /', event_type, {_A}, '200', {_A}, '99 HTTP/1.1\" 404 ', k, ' \"r', {_B}, '\" \"a\"')",
    "apache": f"concat('[Mon Jan 01 00:00:00.1 2024] [co', {_B}, 're:error] [pid 1] [client ', ip, ':1000] a', {_A}, k, {_B}, 'b')",
    "nginx": f"concat('2024/01/01 00:00:00 [error] 7#0: *3 a', {_A}, k, {_B}, 'b, client: ', ip, ', request: \"GET /', {_A}, '\"')",
}


@query(SQL + """, t as (select *, chr(31) as a, chr(30) as b, concat('a', chr(31), k, chr(30), 'b') as m from h)
select event_id, unnest([{'kind': 'bsd', 'x': 'ho' || a || 'st', 'y': event_type || b, 'z': m}, {'kind': 'ietf', 'x': null, 'y': null, 'z': null}, {'kind': 'access', 'x': '/' || event_type || a || '200' || a || '99', 'y': '404', 'z': k::varchar},
    {'kind': 'apache', 'x': 'co' || b || 're', 'y': ip, 'z': m}, {'kind': 'nginx', 'x': ip, 'y': 'GET /' || a, 'z': m}], recursive := true) from t""")
def parse_separators(spark, sf):  # noqa: ANN001, ANN201
    """Lines that hold the parsers' own separators give the same fields, and forge none."""
    fields = {"bsd": ("hostname", "daemon", "message"), "ietf": ("hostname", "daemon", "message"), "access": ("path", "status", "bytes"), "apache": ("module", "client", "message"), "nginx": ("client", "request", "message")}
    parsers = {"bsd": parse.parse_bsd_syslog, "ietf": parse.parse_ietf_syslog, "access": parse.parse_http_access, "apache": parse.parse_apache_error, "nginx": parse.parse_nginx_error}
    rows = dealt(spark, sf).selectExpr("event_id", *(f"{text} as {kind}" for kind, text in FORGED.items()))
    rows = rows.select("event_id", *(parser(F.col(kind)).alias(kind) for kind, parser in parsers.items()))
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), *(F.col(f"{kind}.{n}").alias(a) for n, a in zip(names, "xyz", strict=True))) for kind, names in fields.items()))
    return rows.select("event_id", F.explode(each).alias("r")).select("event_id", "r.*")


#: A field of 2,000 to 5,000 characters with quotes, escapes, commas and dots, as a sender may choose it.
_LONG = "concat(repeat(concat('x', chr(92), '\"', ', ', chr(92), chr(92), 'b.', event_type, '='), 150 + k), 'end')"
_LONG_LINES = {
    "ietf": f"concat('<13>1 2024-01-01T00:00:00Z h ', event_type, ' - - [a b=\"', {_LONG}, '\"][c d=\"]\"] value ', k)",
    "access": f"concat(ip, ' - - [t] \"GET /', {_LONG}, ' HTTP/1.1\" 200 ', k, ' \"-\" \"', {_LONG}, '\"')",
    "access_open": f"concat(ip, ' - - [t] \"GET / HTTP/1.1\" 200 ', k, ' \"-\" \"', {_LONG})",
    "nginx": f"concat('2024/01/01 00:00:00 [error] 7#0: *3 ', {_LONG}, ', client: ', ip, ', request: \"', {_LONG}, ', client: 6.6.6.6\", host: \"h\"')",
    "pairs": f"concat('n=', k, ' long=\"', {_LONG}, '\" srcip=', ip, ' long=again')",
    "tokens": "concat(repeat('label-1.', 300 + k), ' probe from ', ip)",
}


@query(SQL + f""", t as (select *, {_LONG} as long from h)
select event_id, unnest([{{'kind': 'ietf', 'x': event_type, 'y': 'value ' || k}}, {{'kind': 'access', 'x': md5('/' || long), 'y': md5(long)}}, {{'kind': 'access_open', 'x': null, 'y': null}},
    {{'kind': 'nginx', 'x': ip, 'y': md5(long || ', client: 6.6.6.6')}}, {{'kind': 'pairs', 'x': ip, 'y': md5(long)}}, {{'kind': 'tokens', 'x': ip, 'y': null}}], recursive := true) from t""")
def parse_long_lines(spark, sf):  # noqa: ANN001, ANN201
    """Long quoted fields are read whole; a line whose last quote is missing is no access line."""
    rows = dealt(spark, sf).selectExpr("event_id", *(f"{text} as {kind}" for kind, text in _LONG_LINES.items()))
    ietf, access, opened, nginx, pairs = parse.parse_ietf_syslog(F.col("ietf")), parse.parse_http_access(F.col("access")), parse.parse_http_access(F.col("access_open")), parse.parse_nginx_error(F.col("nginx")), parse.parse_key_value(F.col("pairs"))
    token = P.first_match(F.col("tokens"), [r"^%%%%DNS%%%% nothing", r"probe from %%%%SRC%%%%$"])
    rows = rows.select("event_id", ietf.alias("ietf"), access.alias("access"), opened.alias("access_open"), nginx.alias("nginx"), pairs.alias("pairs"), token.alias("tokens"))
    between = lambda c, a, b: F.when(F.startswith(c, F.lit(a)) & F.endswith(c, F.lit(b)), parse.octets(F.col(c), len(a) + 1, F.octet_length(c) - len(a + b))).otherwise(F.when(F.col(c).isNotNull(), ""))
    # the tail of a path is cut at its first space by the request's own grammar
    fields = {
        "ietf": ("ietf.daemon", F.col("ietf.message")), "access": (F.md5(between("access.request", "GET ", " HTTP/1.1")), F.md5("access.user_agent")),
        "access_open": ("access_open.host", F.col("access_open.path")), "nginx": ("nginx.client", F.md5("nginx.request")),
        "pairs": (F.try_element_at("pairs", F.lit("srcip")), F.md5(F.try_element_at("pairs", F.lit("long")))), "tokens": ("tokens.SRC", F.lit(None).cast("string")),
    }
    col = lambda c: F.col(c) if isinstance(c, str) else c
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), col(x).alias("x"), y.alias("y")) for kind, (x, y) in fields.items()))
    return rows.select("event_id", F.explode(each).alias("r")).select("event_id", "r.*")


#: What follows ``from`` in a line, and what each token takes of it: addresses of both families, mapped ones, names, networks,
#: and what is none of these.
TOKEN_CASES = [
    ("10.{a}.{b}.{c}", "IP4 ADDR HOST SUBNET SRC DEST"), ("10.{a}.{b}.{c}/24", "SUBNET"), ("10.{a}.{b}.256", ""), ("999.{a}.{b}.{c}", ""),
    ("2001:db8:{a}::{b}", "IP6 ADDR HOST SUBNET SRC DEST"), ("2001:db8:{a}::/48", "SUBNET"), ("::ffff:10.{a}.{b}.{c}", "IP6 ADDR HOST SUBNET SRC DEST"), ("2001:db8:{a}::/129", ""),
    ("host-{a}.example.org", "DNS HOST"), ("nowhere{a}", ""), ("host.{a}", ""), ("-x.example{a}.org", ""), ("1:2:{a}:4:5:6:7:{b}", "IP6 ADDR HOST SUBNET SRC DEST"), ("1:2:3:4:5:6:{a}", ""),
]
_CASE = lambda join: "case " + " ".join(f"when event_id % {len(TOKEN_CASES)} = {k} then {join(t)}" for k, (t, _) in enumerate(TOKEN_CASES)) + " end"
_SHAPE = lambda t: "replace(replace(replace('" + t + "', '{a}', cast(user_id % 200 as " + "{text}" + ")), '{b}', cast(k % 10 as " + "{text}" + ")), '{c}', cast(user_id % 50 + 1 as " + "{text}" + "))"
_TOKEN_NAMES = ("IP4", "IP6", "ADDR", "DNS", "HOST", "SUBNET", "SRC", "DEST")


@query(SQL + ", t as (select *, " + _CASE(_SHAPE).replace("{text}", "varchar") + f" as x, event_id % {len(TOKEN_CASES)} as n from h)\nselect event_id, " + ", ".join(
    f"case when n in ({', '.join(str(k) for k, (_, names) in enumerate(TOKEN_CASES) if t in names.split()) or '-1'}) then x end as {t.lower()}" for t in _TOKEN_NAMES) + " from t")
def match_tokens(spark, sf):  # noqa: ANN001, ANN201
    """Each token on lines that end with an address, a name, a network, or something that only looks like one."""
    rows = hits(spark, sf).selectExpr("event_id", f"concat('denied from ', {_CASE(_SHAPE).replace('{text}', 'string')}) as line")
    return rows.select("event_id", *(P.extract_tokens(F.col("line"), f"from %%%%{t}%%%%$")[t].alias(t.lower()) for t in _TOKEN_NAMES))


@query("""with l as (select conv_id, turn, role = 'user' as opens, role || ':' || text as line from conversations),
r as (select *, sum(case when opens or turn = 0 then 1 else 0 end) over (partition by conv_id order by turn) as rec from l),
c as (select *, (row_number() over (partition by conv_id, rec order by turn) - 1) // 3 as chunk from r)
select conv_id as source, min(turn) as seq, md5(string_agg(line, chr(10) order by turn)) as line_md5, count(*)::int as n_lines from c group by conv_id, rec, chunk""")
def join_multiline(spark, sf):  # noqa: ANN001, ANN201
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("seq"), (F.col("turn") * 1_000_000).alias("us"), F.concat_ws(":", "role", "text").alias("line"))
    glued = M.join_multiline(rows, r"^(?!user:)", max_lines=3, flush_after=2)
    return glued.select("source", "seq", F.md5("line").alias("line_md5"), "n_lines")


# --- predicates


@query("""select doc_id, text like '%the%' or text like '%die%' as has, starts_with(text, 'The') as begins, ends_with(text, '.') as ends, regexp_matches(text, '[0-9]{3}') as re,
    lang = 'en' or lang = 'de' as eq, coalesce(lang = source, false) as same, not coalesce(lang = 'fr', false) as negated, true as there, n_chars > 1000 as longer,
    contains(lower(text), 'und') and contains(lower(text), 'die') as both_nocase, lang = 'es' or regexp_matches(lang, '^f') as listed from documents""")
def predicates(spark, sf):  # noqa: ANN001, ANN201
    of = {"text": F.col("text"), "lang": F.col("lang"), "source": F.col("source"), "n": F.col("n_chars").cast("string")}
    p = P.Predicate
    cols = {
        "has": p("text", "contains", ["the", "die"]), "begins": p("text", "startswith", ["The"]), "ends": p("text", "endswith", ["."]), "re": p("text", "re", ["[0-9]{3}"]),
        "eq": p("lang", "eq", ["en", "de"]), "same": p("lang", "eq", ["source"], fieldref=True), "negated": p("lang", "eq", ["fr"], negate=True), "there": p("lang", "exists"),
        "longer": p("n", "gt", [1000]), "both_nocase": p("text", "contains", ["UND", "DIE"], all=True, nocase=True),
    }
    return table(spark, sf, "documents").select("doc_id", *(c.column(of).alias(n) for n, c in cols.items()), P.matcher_list(F.col("lang"), ["es", "/^f/"]).alias("listed"))


@query(SQL + """select event_id, user_id % 4 = 1 and k % 8 < 4 as in_cidr, k % 8 >= 6 as numeric_ge, ip not like '10.2.%' as not_in from h""")
def predicate_numbers(spark, sf):  # noqa: ANN001, ANN201
    of = {"ip": F.col("ip"), "k": (F.col("k") % 8).cast("string"), "word": F.col("event_type")}
    p = P.Predicate
    return hits(spark, sf).select(
        "event_id", p("ip", "cidr", ["10.1.0.0/22"]).column(of).alias("in_cidr"), p("k", "ge", ["6"]).column(of).alias("numeric_ge"), p("ip", "cidr", ["10.2.0.0/16"], negate=True).column(of).alias("not_in"),
    ).where(~p("word", "gt", [0]).column(of))


@query("""select doc_id, contains(text, 'the') as plain, contains(lower(text), 'the') as lowered, contains(text, 'the') as from_base64, contains(text, ' ') as from_url,
    contains(text, 'the') as from_both, contains(lower(text), 'the') as from_three from documents""")
def predicate_decode(spark, sf):  # noqa: ANN001, ANN201
    of = {
        "text": F.col("text"), "coded": F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", ""),
        "url": F.replace(F.replace(F.col("text"), F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")),
        # base64 in UTF-16 big endian, as bytes look one by one
        "wide": F.regexp_replace(F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", ""), "(.)", "\x00$1"),
    }
    docs = table(spark, sf, "documents").select("doc_id", *(c.alias(n) for n, c in of.items()))  # each form is made once
    p = lambda f, steps, word: P.Predicate(f, "contains", [word], decode=steps).column({n: F.col(n) for n in of})
    return docs.select("doc_id", p("text", [], "the").alias("plain"), p("text", ["lower"], "the").alias("lowered"), p("coded", ["base64"], "the").alias("from_base64"), p("url", ["url"], " ").alias("from_url"),
        p("wide", ["utf16", "base64"], "the").alias("from_both"), p("wide", ["utf16", "base64", "lower"], "the").alias("from_three"))


@query("""select doc_id, contains(text, 'und') or contains(text, 'que') or source in ('src1') as anywhere, contains(source, '1') as within, not (contains(text, 'und') or source like '%und%') as none from documents""")
def keywords(spark, sf):  # noqa: ANN001, ANN201
    fields = F.create_map(F.lit("meta.source"), F.col("source"), F.lit("meta.exact"), F.when(F.col("source") == "src1", "que"))
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", P.keywords(fields, F.col("text"), ["und", "que"]).alias("anywhere"), P.keywords(F.create_map(F.lit("meta.source"), F.col("source")), F.col("text"), ["1"], within="meta").alias("within"), P.keywords(F.create_map(F.lit("s"), F.col("source")), F.col("text"), ["und"], negate=True).alias("none"))


@query("""with s as (select doc_id, contains(text, 'the') as a1, contains(text, 'and') as a2, contains(text, 'die') as b from documents)
select doc_id, (a1 and not b) or (b and not a1) as either, a1::int + a2::int + b::int >= 2 as two, a1 and a2 as all_a, (a1 or a2) and not b as mixed from s""")
def selections(spark, sf):  # noqa: ANN001, ANN201
    sel = {n: F.coalesce(F.col("text").contains(w), F.lit(False)) for n, w in (("sel_a1", "the"), ("sel_a2", "and"), ("other", "die"))}
    conds = {"either": "(sel_a1 and not other) or (other and not sel_a1)", "two": "2 of them", "all_a": "all of sel_a*", "mixed": "1 of sel_* and not other"}
    return table(spark, sf, "documents").select("doc_id", *(P.condition(c, sel).alias(n) for n, c in conds.items()))


@query(SQL + """select event_id, case when event_type = 'view' then null when event_type = 'error' then 0 else 1 end as pattern, case when event_type = 'error' then ip end as src,
    case when event_type not in ('view', 'error') then k::varchar end as n, event_type = 'view' as vetoed from h where event_id % 17 <> 0
    union all select event_id, null, null, null, false from h where event_id % 17 = 0""")
def first_match(spark, sf):  # noqa: ANN001, ANN201
    rows = lines(spark, sf, "bsd")
    line = F.col("line")
    vetoed = P.ignored(line, [r" view\["])
    found = P.first_match(line, [r"error\[\d+\]: value \d+ from %%%%SRC%%%%$", r"value (?<N>\d+) from"])
    rows = rows.select("event_id", vetoed.alias("vetoed"), F.when(~vetoed, found).alias("m"))
    return rows.select("event_id", "m.pattern", F.col("m.SRC").alias("src"), F.col("m.N").alias("n"), "vetoed")


@query(SQL + """select event_id, ip as a, 'lifted' as b, 'parsed' as c, case when k % 2 = 0 then 'own' else 'parsed' end as d from h""")
def compose_fields(spark, sf):  # noqa: ANN001, ANN201
    m = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v)))
    out = P.compose_fields(m(a=F.lit("parsed"), b=F.lit("parsed"), c=F.lit("parsed"), d=F.lit("parsed")), m(b=F.lit("lifted")), m(a=F.col("ip"), d=F.when(F.col("k") % 2 == 0, "own")))
    return hits(spark, sf).select("event_id", *(F.element_at(out, k).alias(k) for k in "abcd"))


# --- addresses


def fold_sql(key: str, weight: str, find: int | str, most: int | str, where: str = "true", member: str = "ip") -> str:
    """Crossings as a recursion over each key's hits: state is the list of live ones. ``find`` and ``most`` may be those of each hit."""
    return SQL + f""", q as (select {key} as key, us, ord, {weight} as w, {member} as member, ({find})::bigint as ft, ({most})::bigint as most, row_number() over (partition by {key} order by us, ord) as n from h where {where}),
st as (with recursive st(key, n, live, us, ord, score, most, crossed) as (
  select distinct key, 0::bigint, []::struct(us bigint, w bigint, member varchar)[], 0::bigint, 0::bigint, 0::bigint, 0::bigint, false from q
  union all
  select key, n, live, us, ord, score, most, score >= most
  from (select key, n, live, us, ord, most, list_sum(list_transform(live, lambda x: x.w))::bigint as score
        from (select st.key, q.n, q.us, q.ord, q.most, list_append(list_filter(case when st.crossed then [] else st.live end, lambda x: x.us > q.us - q.ft * 1000000), {{'us': q.us, 'w': q.w::bigint, 'member': q.member::varchar}}) as live
              from st join q on q.key = st.key and q.n = st.n + 1))
) select * from st where n > 0)
"""


def _mixed(ip: str, odd: str) -> Column:
    """10.a.b.c, or the IPv6 address 2001:db9:a:b::c where ``odd`` is an odd number: lists name networks of both."""
    return F.when(F.pmod(odd, F.lit(2)) == 1, F.regexp_replace(ip, r"^10\.(\d+)\.(\d+)\.(\d+)$", "2001:db9:$1:$2::$3")).otherwise(F.col(ip))


#: The same address in DuckDB, and its network: /24 or /48.
MIXED_SQL = "case when event_id % 2 = 1 then concat('2001:db9:', user_id % 4, ':', k % 8, '::', user_id % 50 + 1) else ip end"
MIXED_NET_SQL = "case when event_id % 2 = 1 and user_id % 4 = 0 then '2001:db9::/48' when event_id % 2 = 1 then concat('2001:db9:', user_id % 4, '::/48') else concat('10.', user_id % 4, '.', k % 8, '.0/24') end"


@query(SQL + """select event_id, 'v4' as family, concat('10.', user_id % 4, '.', k % 8, '.0/24') as net24, concat('10.', user_id % 4, '.', k % 8 - k % 4, '.0/22') as net22, null::varchar as bad,
    'v6' as family6, concat('2001:db8:', case when user_id % 50 + 1 > 0 then printf('%x', user_id % 50 + 1) end, '::/48') as net6 from h""")
def ip_functions(spark, sf):  # noqa: ANN001, ANN201
    v6 = F.format_string("2001:db8:%x::%x", F.col("user_id") % 50 + 1, F.col("k") + 1)
    ip = F.when(F.col("k") % 2 == 0, F.col("ip")).otherwise(F.concat(F.lit("::ffff:"), "ip"))
    return hits(spark, sf).select(
        "event_id", ip_family(ip).alias("family"), ip_network(ip, F.lit(24)).alias("net24"), ip_network(ip, F.lit(22)).alias("net22"), ip_network(ip, F.lit(33)).alias("bad"), ip_family(v6).alias("family6"), ip_network(v6, F.lit(48)).alias("net6"),
    )


@query(SQL + """select event_id, user_id % 4 = 1 or (user_id % 4 = 2 and k % 8 < 2) or ip = '10.3.0.8' as listed from h""")
def ip_in_list(spark, sf):  # noqa: ANN001, ANN201
    nets = values(spark, "cidr string", [("10.1.0.0/16",), ("10.2.0.0/23",), ("10.3.0.8",), ("junk/99",), ("2001:db8::/32",), ("2001:db9:1::/48",), ("2001:DB9:2::/63",), ("2001:db9:3:0::8",)])
    return ip_in_any(hits(spark, sf).withColumn("addr", _mixed("ip", "event_id")), "addr", nets, "listed").select("event_id", "listed")


# --- gates


@query(SQL + """select event_id, ip from h where not (user_id % 4 = 0) or event_type = 'view'""")
def drop_ignored(spark, sf):  # noqa: ANN001, ANN201
    return G.drop_ignored(hits(spark, sf).withColumn("addr", _mixed("ip", "event_id")), values(spark, "cidr string", [("10.0.0.0/16",), ("2001:db9:0::/48",)]), "addr", exempt=F.col("event_type") == "view").select("event_id", "ip")


@query(SQL + """select event_id, ip from h where user_id % 4 in (1, 3) and not (user_id % 4 = 3 and k % 8 = 7)""")
def ban_not_internal(spark, sf):  # noqa: ANN001, ANN201
    own = [("10.0.0.0/16",), ("10.2.0.0/16",), ("10.3.7.0/24",), ("2001:db9:0::/48",), ("2001:db9:2::/48",), ("2001:db9:3:7::/64",)]
    return G.ban_not_internal(hits(spark, sf).withColumn("addr", _mixed("ip", "event_id")), values(spark, "cidr string", own), "addr").select("event_id", "ip")


def _number(a: int, b: int, c: int, d: int) -> int:
    return ((a * 256 + b) * 256 + c) * 256 + d


RANGES = [(_number(9, 0, 0, 0), _number(10, 0, 255, 255), "DE"), (_number(10, 1, 0, 0), _number(10, 1, 3, 255), "FR"), (_number(10, 1, 4, 0), _number(10, 2, 255, 255), "ES")]
#: The same countries in IPv6, for the addresses of _mixed; the first range begins in another block.
RANGES6 = [("2001:c00::", "2001:db9:0:ffff:ffff:ffff:ffff:ffff", "DE"), ("2001:db9:1::", "2001:db9:1:3:ffff:ffff:ffff:ffff", "FR"), ("2001:db9:1:4::", "2001:db9:2:ffff:ffff:ffff:ffff:ffff", "ES")]
_LOCATED = SQL + f""", r as (select * from {literal(RANGES, 'first, last, code')}),
n as (select *, {MIXED_SQL} as addr, list_reduce(list_transform(string_split(ip, '.'), lambda x: x::bigint), lambda a, x: a * 256 + x) as num from h)
select event_id, addr, code as country from n left join r on num between first and last"""


def _ranges(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return values(spark, "first long, last long, code string", RANGES), values(spark, "first string, last string, code string", RANGES6)


@query(_LOCATED + " where code in ('DE', 'FR')")
def country_gate(spark, sf):  # noqa: ANN001, ANN201
    four, six = _ranges(spark)
    rows = hits(spark, sf).select("event_id", _mixed("ip", "event_id").alias("addr"))
    return G.country_gate(rows, ["addr"], four, ["DE", "FR"], ranges6=six, keep="country")


@query(_LOCATED)
def enrich_country(spark, sf):  # noqa: ANN001, ANN201
    four, six = _ranges(spark)
    return E.enrich_country(hits(spark, sf).select("event_id", _mixed("ip", "event_id").alias("addr")), four, "addr", six)


@query(SQL + """select event_id from h where (user_id % 4 = 1 or k % 8 = 3 and user_id % 4 = 0) and event_type in ('error', 'click')""")
def blocklist_gate(spark, sf):  # noqa: ANN001, ANN201
    a, b = values(spark, "cidr string", [("10.1.0.0/16",), ("2001:db9:0:3::/64",)]), values(spark, "cidr string", [("10.0.3.0/24",), ("2001:db9:1::/48",)])
    words = values(spark, "entry string", [("ERROR",), ("Click",)])
    return G.blocklist_gate(hits(spark, sf).withColumn("addr", _mixed("ip", "event_id")), [("addr", [a, b], "cidr"), ("event_type", [words], "nocase")]).select("event_id")


@query(SQL + """select event_id, (dow in (1, 2) and hm between 900 and 1700) or hm >= 2200 or hm <= 130 as active, not ((dow in (1, 2) and hm between 900 and 1700) or hm >= 2200 or hm <= 130) as inactive, false as unread
    from (select *, dayofweek(make_timestamp(us)) as dow, hh * 100 + mi as hm from h)""")
def active_time_gate(spark, sf):  # noqa: ANN001, ANN201
    windows = [{"days": [1, 2], "hours": [(900, 1700)]}, {"hours": [(2200, 130)]}]
    at = F.when(F.col("k") % 3 == 0, F.col("sec").cast("string")).when(F.col("k") % 3 == 1, F.col("us").cast("string")).otherwise(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return hits(spark, sf).select("event_id", G.active_time(at, windows).alias("active"), G.active_time(at, windows, negate=True).alias("inactive"), G.active_time(F.lit("soon"), windows).alias("unread"))


@query(SQL + """, t as (select *, case user_id % 4 when 0 then 'ok' when 1 then 'ok' when 2 then 'nxdomain' else 'servfail' end as status, user_id % 4 = 0 as confirmed from h)
select event_id, ip, 'match' as gate from t where confirmed and status = 'ok'
union all select event_id, ip, 'negate' from t where (status = 'ok' and not confirmed) or status = 'nxdomain'""")
def reverse_dns_gate(spark, sf):  # noqa: ANN001, ANN201
    rows = hits(spark, sf)
    one = rows.select("ip", F.split("ip", r"\.")[1].alias("net")).distinct()
    status = F.when(F.col("net") == "2", "nxdomain").when(F.col("net") == "3", "servfail").otherwise("ok")
    name = F.concat(F.lit("Host-"), F.replace("ip", F.lit("."), F.lit("-")), F.lit(".Example.org."))
    ptr = one.select("ip", status.alias("status"), F.array(name).alias("names"))
    forward = one.select(F.lower(name).alias("name"), F.when(F.col("net") == "0", F.array("ip")).otherwise(F.array(F.lit("192.0.2.1"))).alias("addrs"))
    hit = G.reverse_dns_gate(rows, "ip", ptr, forward, pattern=r"\.example\.org$").select("event_id", "ip", F.lit("match").alias("gate"))
    return hit.unionByName(G.reverse_dns_gate(rows, "ip", ptr, forward, pattern=r"\.example\.org$", negate=True).select("event_id", "ip", F.lit("negate").alias("gate")))


@query(SQL + """select event_id, unnest(case when k % 3 <> 0 then [ip] when event_type = 'error' then ['192.0.2.1', '192.0.2.2'] when event_type = 'view' then ['192.0.2.9'] else [] end) as offender from h""")
def resolve_hostnames(spark, sf):  # noqa: ANN001, ANN201
    hosts = values(spark, "name string, addrs array<string>", [("error.example", ["192.0.2.1", "192.0.2.2"]), ("VIEW.example", ["192.0.2.9"]), ("click.example", [f"192.0.2.{k}" for k in range(5)])])
    named = hits(spark, sf).select("event_id", F.when(F.col("k") % 3 != 0, F.col("ip")).otherwise(F.concat("event_type", F.lit(".Example"))).alias("offender"))
    return G.resolve_hostnames(named, hosts, "resolve")


@query(fold_sql("concat('host-', user_id % 9)", "1", DAY, 40) + """, a as (select unnest(range(9)) as x)
select concat('10.', x % 4, '.0.', x) as key, us, ord, score from st join a on st.key = concat('host-', x) where crossed and x not in (7, 8) and x % 4 <> 0
union all select concat('2001:db9:', x % 4, '::', x), us, ord, score from st join a on st.key = concat('host-', x) where crossed and x not in (7, 8) and x % 4 <> 3""")
def resolve_ban(spark, sf):  # noqa: ANN001, ANN201
    """Offenders counted by name; a crossing bans the name's addresses outside the ignored and own networks."""
    rows = hits(spark, sf).select("bucket", F.format_string("HOST-%d.", F.col("user_id") % 9).alias("key"), "us", "ord", F.lit(1).cast("long").alias("w"))
    crossings = C.threshold_crossings(rows, DAY, 40).drop("bucket")
    table = [(f"host-{n}", [f"10.{n % 4}.0.{n}", f"2001:db9:{n % 4}::{n}", "no address"]) for n in range(7)] + [("host-7", [f"10.1.0.{k}" for k in range(5)])]
    fences = [values(spark, "cidr string", [("10.0.0.0/16",)]), values(spark, "cidr string", [("2001:db9:3::/48",)])]
    return G.resolve_ban(crossings, values(spark, "name string, addrs array<string>", table), fences)


# --- marks, tracks, correlation


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    rows = hits(spark, sf).where("event_type in ('error', 'purchase', 'click')")
    return rows.select(F.when(F.col("event_type") == "click", "seen").otherwise("bad").alias("name"), F.col("user_id").alias("key"), "us", "ord", F.when(F.col("event_type") == "purchase", "unset").otherwise("set").alias("op"), F.concat(F.lit("v"), F.col("k") % 2).alias("value"), F.lit(2 * DAY).alias("ttl"))


MARKS_SQL = SQL + f""", m as (select case when event_type = 'click' then 'seen' else 'bad' end as name, user_id as key, us, ord, event_type <> 'purchase' as is_set, concat('v', k % 2) as value from h where event_type in ('error', 'purchase', 'click')),
isl as (select *, case when is_set then us + {2 * DAY * 1_000_000} end as expires, lag(case when is_set then us + {2 * DAY * 1_000_000} end) over w as before from m window w as (partition by name, key order by us, ord)),
fs as (select *, last_value(case when is_set and (before is null or before <= us) then us end ignore nulls) over (partition by name, key order by us, ord rows unbounded preceding) as first_set from isl)
"""
_LIVE = MARKS_SQL + """, p as (select event_id as id, user_id as key, us, ord, k from h where event_type = 'view'),
live as (select p.id, p.k, f.name, f.value, f.first_set, f.expires from p asof join (select *, us * 1000000 + ord as o from fs where name = 'bad') f on p.key = f.key and p.us::hugeint * 1000000000 + p.ord > f.o where f.is_set and f.expires > p.us
         union all select p.id, p.k, f.name, f.value, f.first_set, f.expires from p asof join (select *, us * 1000000 + ord as o from fs where name = 'seen') f on p.key = f.key and p.us::hugeint * 1000000000 + p.ord > f.o where f.is_set and f.expires > p.us)
"""
_LIVE = _LIVE.replace("us * 1000000 + ord", "us::hugeint * 1000000000 + ord")


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf).where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "us", "ord", "k")


@query(_LIVE + "select id, name, value, first_set, expires from live")
def as_of_marks(spark, sf):  # noqa: ANN001, ANN201
    return K.as_of_marks(_probes(spark, sf), _marks(spark, sf))


@query(_LIVE + """select id, 'marked' as gate from live where name = 'bad' union all select id, 'marked_value' from live where name = 'bad' and value = concat('v', k % 2)
union all select id, 'not_marked' from p where id not in (select id from live where name = 'bad')
union all select id, 'not_marked_value' from p where id not in (select id from live where name = 'bad' and value = concat('v', k % 2))
union all select a.id, 'sequence' from live a join live b using (id) where a.name = 'seen' and b.name = 'bad' and a.first_set <= b.first_set""")
def mark_gates(spark, sf):  # noqa: ANN001, ANN201
    probes = _probes(spark, sf)
    live = K.as_of_marks(probes, _marks(spark, sf))
    value = F.concat(F.lit("v"), F.col("k") % 2)
    got = {
        "marked": K.marked(probes, live, ["bad"]), "marked_value": K.marked(probes, live, ["bad"], value), "not_marked": K.not_marked(probes, live, ["bad"]),
        "not_marked_value": K.not_marked(probes, live, ["bad"], value), "sequence": K.sequence(probes, live, ["seen", "bad"]),
    }
    return M.union_watchers({n: df.select("id") for n, df in got.items()}).withColumnRenamed("watcher", "gate")


@query(MARKS_SQL + """, tt as (select max(us) - 86400000000 as t from h),
l as (select *, row_number() over (partition by name, key order by us desc, ord desc) as n from fs, tt where us <= t)
select name, key, value, first_set, expires from l where n = 1 and is_set and expires > t""")
def live_marks(spark, sf):  # noqa: ANN001, ANN201
    at = hits(spark, sf).agg(F.max("us")).head()[0] - DAY * 1_000_000
    return K.live_marks(_marks(spark, sf), at)


@query(SQL + f""", d as (select event_type = 'purchase' as lifts, (user_id % 7)::varchar as name, user_id as key, ord, concat('v', k) as value, us + 864000000000 as expires, us as first_set from h),
tt as (select max(us) - 432000000000 as t from h), u as (select *, max(case when lifts then ord end) over (partition by name, key) as last_unset from d),
r as (select * from u, tt where not lifts and expires > t and (last_unset is null or ord > last_unset))
select name, key, max(expires) as expires, min(first_set) as first_set, arg_max(value, expires::varchar || value) as value from r group by name, key""")
def merge_fleet_marks(spark, sf):  # noqa: ANN001, ANN201
    rows = hits(spark, sf)
    at = rows.agg(F.max("us")).head()[0] - 5 * DAY * 1_000_000
    d = rows.select((F.col("user_id") % 7).cast("string").alias("name"), F.col("user_id").alias("key"), "ord", F.when(F.col("event_type") == "purchase", "unset").otherwise("set").alias("op"), F.concat(F.lit("v"), "k").alias("value"), (F.col("us") + 10 * DAY * 1_000_000).alias("expires"), F.col("us").alias("first_set"))
    return K.merge_fleet_marks(d, at)


TRACK_SQL = SQL + f""", t as (select event_id, user_id as key, us, ord, event_type in ('click', 'error') as harvests, case when event_type = 'error' then ip end as addr from h),
s as (select *, last_value(case when harvests then us end ignore nulls) over (partition by key order by us, ord rows between unbounded preceding and 1 preceding) as seen from t),
b as (select *, coalesce(us - seen < {DAY * 1_000_000}, false) as live_before from s),
i as (select *, sum(case when harvests and not live_before then 1 else 0 end) over (partition by key order by us, ord rows unbounded preceding) as isl from b),
r as (select *, case when live_before or harvests then last_value(case when harvests then addr end ignore nulls) over (partition by key, isl order by us, ord rows unbounded preceding) end as after_addr,
             case when live_before then last_value(case when harvests then addr end ignore nulls) over (partition by key, isl order by us, ord rows between unbounded preceding and 1 preceding) end as before_addr from i)
"""


def _track_rows(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf).select("event_id", F.col("user_id").cast("long").alias("key"), "us", "ord", F.col("event_type").isin("click", "error").alias("harvests"), F.when(F.col("event_type") == "error", F.col("ip")).alias("addr"))


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    return K.tracks(_track_rows(spark, sf), ["addr"], DAY)


@query(TRACK_SQL + "select event_id, live_before, before_addr, after_addr from r")
def track_harvest(spark, sf):  # noqa: ANN001, ANN201
    return _tracks(spark, sf).select("event_id", "live_before", "before_addr", "after_addr")


@query(TRACK_SQL + """select event_id, before_addr as addr, 'tracked' as gate from r where live_before and before_addr like '10.1.%' union all select event_id, addr, 'not_tracked' from r where not live_before""")
def track_gates(spark, sf):  # noqa: ANN001, ANN201
    rows = _tracks(spark, sf)
    hit = K.tracked(rows.drop("addr"), F.col("before_addr").startswith("10.1."), {"addr": "addr"}).select("event_id", "addr", F.lit("tracked").alias("gate"))
    return hit.unionByName(K.not_tracked(rows).select("event_id", "addr", F.lit("not_tracked").alias("gate")))


@query(SQL + f""", tt as (select max(us) - 43200000000 as t from h),
x as (select *, concat(user_id, chr(31), event_type) as key, coalesce(us - lag(us) over (partition by user_id, event_type order by us, ord) < {2 * DAY * 1_000_000}, false) as cont from h, tt where us <= t),
i as (select *, sum(case when cont then 0 else 1 end) over (partition by key order by us, ord rows unbounded preceding) as isl from x),
l as (select key, arg_max(isl, us) as isl, max(us) + {2 * DAY * 1_000_000} as expires from i group by key)
select key, event_type as part2, l.expires, arg_max(ip, us) as addr from i join l using (key, isl), tt where l.expires > tt.t group by key, event_type, l.expires""")
def live_tracks(spark, sf):  # noqa: ANN001, ANN201
    rows = hits(spark, sf)
    at = rows.agg(F.max("us")).head()[0] - DAY * 500_000
    rows = rows.select(K.compound_key([F.col("user_id").cast("string"), F.col("event_type")]).alias("key"), "us", "ord", F.lit(True).alias("harvests"), F.col("ip").alias("addr"))
    return K.live_tracks(rows, ["addr"], 2 * DAY, at).select("key", F.col("parts")[1].alias("part2"), "expires", "addr")


def _offenses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = hits(spark, sf)
    key = F.col("user_id").alias("key")
    return rows.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), key, "us", "ord"), rows.where("event_type = 'click'").select(key, "us", "ord", F.col("ip").alias("src"))


@query(SQL + f""", c as (select user_id as key, us, ord, ip from h where event_type = 'click'), o as (select event_id as id, user_id as key, us, ord from h where event_type = 'purchase')
select o.id, coalesce(c.us + {DAY * 1_000_000} > o.us, false) as resolved, case when c.us + {DAY * 1_000_000} > o.us then c.ip end as src from o asof left join c on o.key = c.key and o.us >= c.us""")
def correlate_context(spark, sf):  # noqa: ANN001, ANN201
    offenses, captures = _offenses(spark, sf)
    return K.correlate_context(offenses, captures, ["src"], DAY).select("id", "resolved", "src")


@query(SQL + f""", c as (select user_id as key, us, ord, ip from h where event_type = 'click'), o as (select event_id as id, user_id as key, us, ord from h where event_type = 'purchase'),
j as (select o.id, o.key, o.us as ous, o.ord as oord, c.us as at_us, c.ip as src from o asof join c on o.key = c.key and o.us < c.us where o.us + {DAY * 1_000_000} > c.us),
n as (select *, row_number() over (partition by key, at_us order by ous desc, oord desc) as n from j) select id, at_us, src from n where n <= 2""")
def correlate_deferred(spark, sf):  # noqa: ANN001, ANN201
    offenses, captures = _offenses(spark, sf)
    return K.correlate_deferred(offenses, captures, ["src"], DAY, most=2).select("id", "at_us", "src")


# --- rows and rules

RULES = [
    M.Rule("errors", [r"value (?<N>\d+) from %%%%SRC%%%%$"], only={"daemon": ["error"]}, marks=[M.Mark("hit"), M.Mark("seen", ["daemon"], "N", 60)]),
    M.Rule("brand", [r"from %%%%SRC%%%%$"], tests=[P.Predicate("N", "exists", negate=True)], ignore=["value 3"], mark_only=True, marks=[M.Mark("pair", ["daemon", "SRC"]), M.Mark("none", ["absent"])]),
    M.Rule("odd", [r"value (?<N>\d*[13579]) from %%%%SRC%%%%$"], detection_vars=["daemon"], marks=[M.Mark("hit", lift=True), M.Mark("late")]),
    M.Rule("any", [r"from %%%%SRC%%%%$"], only={"daemon": ["error", "view"]}),
]
RULE_SQL = SQL + """, f as (select * from h where event_id % 17 <> 0 and k * 2 <= 191),
r as (select *, event_type = 'error' as r0, not starts_with(k::varchar, '3') as r1, k % 2 = 1 as r2, event_type in ('error', 'view') as r3 from f),
x as (select *, unnest([{'n': 0, 'name': 'errors', 'hit': r0}, {'n': 1, 'name': 'brand', 'hit': r1}, {'n': 2, 'name': 'odd', 'hit': r2}, {'n': 3, 'name': 'any', 'hit': r3}]) as u from r),
m as (select *, u.n as rule_int, u.name as rule, case when r0 then 0 when r2 then 2 when r3 then 3 end as first_consumer from x where u.hit)
"""


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    parsed = M.parsed_lines(lines(spark, sf, "bsd"), parse.parse_bsd_syslog)
    return M.match_rules(parsed.select("event_id", "us", "ord", "user_id", "record.daemon", "record.message"), RULES, "message", ["daemon"])


@query(RULE_SQL + """select event_id, rule, rule_int, ip, 'first' as mode, false as demoted from m where rule_int <= coalesce(first_consumer, 9)
union all select event_id, rule, rule_int, ip, 'shadow', rule_int <> 1 and rule_int > coalesce(first_consumer, 9) from m union all select event_id, rule, rule_int, ip, 'all', false from m""")
def overlap(spark, sf):  # noqa: ANN001, ANN201
    rows = _matched(spark, sf)  # one pass over the lines; each mode judges its hits
    modes = F.array(*(F.struct(F.lit(mode).alias("mode"), M.overlap(F.col("hits"), mode).alias("hits")) for mode in ("first", "shadow", "all")))
    judged = rows.select("event_id", F.explode(modes).alias("m")).select("event_id", "m.mode", "m.hits")
    return M.explode_offenders(M.explode_hits(judged)).select("event_id", "rule", "rule_int", "ip", "mode", "demoted")


#: 264 rules, four for each of 66 daemons.
MANY_RULES = [
    M.Rule(f"r{4 * j + q}", [pattern], only={"daemon": [f"d{j}"]}, ignore=ignore, mark_only=q == 2)
    for j in range(66) for q, (pattern, ignore) in enumerate([(r"value (?<N>\d*[0-4]) from %%%%SRC%%%%$", []), (r"value (?<N>\d*[5-9]) from %%%%SRC%%%%$", ["from 10\\.2\\."]), ("from %%%%SRC%%%%$", []), ("value 3", ["nothing"])])
]


@query(SQL + """, f as (select *, (user_id % 66)::int as j from h where event_id % 17 <> 0 and k * 2 <= 191),
m as (select *, unnest([{'q': 0, 'hit': k % 10 < 5}, {'q': 1, 'hit': k % 10 >= 5 and ip not like '10.2.%'}, {'q': 2, 'hit': true}, {'q': 3, 'hit': starts_with(k::varchar, '3')}]) as u from f),
x as (select *, 4 * j + u.q as rule_int, min(case when u.q <> 2 then u.q end) over (partition by event_id) as c from m where u.hit)
select event_id, rule_int::int as rule_int, case when u.q < 2 then k::varchar end as n, case when u.q < 3 then ip end as ip, coalesce(u.q > c, false) and u.q <> 2 as demoted from x""")
def indexed_rules(spark, sf):  # noqa: ANN001, ANN201
    """264 rules as a table that lines meet by their daemon; later ones are shadowed."""
    rows = M.parsed_lines(lines(spark, sf, "bsd"), parse.parse_bsd_syslog).select("event_id", F.concat(F.lit("d"), F.col("user_id") % 66).alias("daemon"), "record.message")
    hit = match_rules_indexed(rows, MANY_RULES, "message", ["daemon"], ["event_id"])
    judged = M.explode_hits(hit.withColumn("hits", M.overlap(F.col("hits"), "shadow")))
    return judged.select("event_id", "rule_int", F.try_element_at("data", F.lit("N")).alias("n"), F.get("offenders", 0).alias("ip"), "demoted")


@query(RULE_SQL + "select event_id, event_type as subject from m where rule_int = 2")
def explode_subjects(spark, sf):  # noqa: ANN001, ANN201
    return M.explode_subjects(M.explode_hits(_matched(spark, sf))).select("event_id", "subject")


@query(RULE_SQL + "select event_id, rule, user_id % 4 <> 0 as fired, case when user_id % 4 <> 0 then ip end as ip from m")
def fired(spark, sf):  # noqa: ANN001, ANN201
    rows, left = _offended(spark, sf)
    return M.fired(rows, left, ["event_id", "rule"]).select("event_id", "rule", "fired", "ip")


def _offended(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Matches, as the table that the match job leaves, and their offenders outside the ignored networks, looked up once for
    all steps that ask who is left."""
    rows = written(M.explode_hits(_matched(spark, sf)), "matches")
    ignored = values(spark, "cidr string", [("10.0.0.0/16",), ("2001:db9:0::/48",)])
    left = G.drop_ignored(M.explode_offenders(rows.select("event_id", "rule", "offenders", "subjects")).withColumn("addr", _mixed("ip", "event_id")), ignored, "addr")
    return rows, written(left.drop("addr"), "survivors")


@query(RULE_SQL + """, b as (select * from m where user_id % 4 <> 0)
select 'hit' as name, ip as key, us, ord as line, 0 as rule_int, 0 as place, 'set' as op, null::varchar as value, 3600::bigint as ttl from b where rule_int = 0
union all select 'seen', event_type, us, ord, 0, 1, 'set', k::varchar, 60 from b where rule_int = 0
union all select 'pair', event_type || chr(31) || ip, us, ord, 1, 0, 'set', null, 3600 from b where rule_int = 1
union all select 'late', ip, us, ord, 2, 0, 'set', null, 3600 from b where rule_int = 2
union all select 'hit', ip, us, ord, 2, 1, 'unset', null, null from b where rule_int = 2""")
def apply_marks(spark, sf):  # noqa: ANN001, ANN201
    rows, left = _offended(spark, sf)
    fired = M.fired(rows, left, ["event_id", "rule"]).where("fired").drop("ip")
    events = M.apply_marks(fired, left, RULES, ["event_id", "rule"])
    return events.select("name", "key", "us", F.col("ord.ord").alias("line"), "ord.rule_int", "ord.place", "op", "value", "ttl")


@query(RULE_SQL + """, b as (select * from m where user_id % 4 <> 0 and rule_int in (0, 2)), y as (select ip as key, arg_max(rule_int, (us::hugeint * 1000000000 + ord) * 10 + rule_int) as last_rule from b group by ip)
select key from y where last_rule = 0""")
def marks_of_rules(spark, sf):  # noqa: ANN001, ANN201
    """apply_marks into live_marks: who has the brand at the end."""
    rows, left = _offended(spark, sf)
    fired = M.fired(rows, left, ["event_id", "rule"]).where("fired").drop("ip")
    events = M.apply_marks(fired, left, RULES, ["event_id", "rule"]).where("name = 'hit'").withColumn("ttl", F.lit(10_000 * DAY).cast("long"))
    at = rows.agg(F.max("us")).head()[0]
    return K.live_marks(events, at).select("key")


@query(SQL + """select watcher, ip, count(*) as n from (select 'web' as watcher, ip from h where event_type = 'error' union all select 'app', ip from h where event_type = 'click') group by all""")
def union_watchers(spark, sf):  # noqa: ANN001, ANN201
    rows = hits(spark, sf)
    return M.union_watchers({"web": rows.where("event_type = 'error'"), "app": rows.where("event_type = 'click'")}).groupBy("watcher", "ip").agg(F.count("*").alias("n"))


@query(SQL + """, l as (select user_id, ip, min(ord) as first_ord from h group by user_id, ip) select user_id as watcher, ip as rule, (row_number() over (partition by user_id order by first_ord))::int as place from l""")
def dedupe_rules(spark, sf):  # noqa: ANN001, ANN201
    rows = hits(spark, sf).select("user_id", "ip", "ord")
    groups = rows.select(F.concat(F.lit("g"), "ord").alias("name"), F.array("ip", "ip").alias("rules"))
    return M.dedupe_listed(rows.select(F.col("user_id").alias("watcher"), F.col("ord").alias("i"), F.concat(F.lit("g"), "ord").alias("name")), groups)


@query(RULE_SQL + """select name as rule, count(*) as cases, sum((found = case name when 'errors' then r0 when 'any' then r3 else r2 end::int)::int)::bigint as passed
    from (select *, 1 as found, unnest(['errors', 'odd', 'any']) as name from r) group by name""")
def evaluate_rules(spark, sf):  # noqa: ANN001, ANN201
    rows = _matched(spark, sf).drop("hits")
    cases = rows.select("event_id", "message", "daemon", F.explode(F.array(F.lit("errors"), F.lit("odd"), F.lit("any"))).alias("rule"))
    data = F.create_map(F.lit("SRC"), F.regexp_extract("message", r"from (\S+)$", 1))
    cases = cases.select(F.col("event_id").alias("case_id"), "rule", "message", "daemon", F.lit(1).alias("found"), data.alias("data"), F.array(F.lit("DEST")).alias("undefed"))
    return M.evaluate_rules(cases, RULES, ["daemon"])


SCENE_RULES = [M.Rule("probe", [r"probe from %%%%SRC%%%%$"], marks=[M.Mark("seen", ttl=DAY)]), M.Rule("worked", [r"login of (?<USER>\S+) from %%%%SRC%%%%$"])]


@query(SQL + f""", l as (select *, lag(event_type) over w as prev, (us - lag(us) over w) // 1000000 as gap from h window w as (partition by user_id order by us, ord))
select 'worked' as rule, count(*) as cases, count(*) filter ((prev = 'click' and gap < {DAY}) or (user_id % 7 = 0 and prev <> 'click' and gap < {100 * DAY})) as passed from l where event_type = 'error' and prev is not null""")
def evaluate_scenes(spark, sf):  # noqa: ANN001, ANN201
    """Scenes of two lines with a clock: what the second needs is a mark of the first, or one from before, which a later one replaces."""
    order = Window.partitionBy("user_id").orderBy("us", "ord")
    rows = hits(spark, sf).withColumns({"prev": F.lag("event_type").over(order), "gap": F.expr("(us - lag(us) over (partition by user_id order by us, ord)) div 1000000")})
    rows = rows.where("event_type = 'error' and prev is not null").withColumn("addr", F.concat(F.lit("10.0.0."), F.col("user_id") % 200))
    line = lambda text, advance: F.struct(text.alias("message"), F.lit("d").alias("daemon"), advance.cast("long").alias("advance"))
    first = F.when(F.col("prev") == "click", F.concat(F.lit("probe from "), "addr")).otherwise("noise")
    second = F.concat(F.lit("login of u"), "user_id", F.lit(" from "), "addr")
    scenes = F.array(line(first, F.lit(0)), line(second, F.col("gap")))
    cases = rows.select(F.col("event_id").alias("case_id"), F.lit("worked").alias("rule"), scenes.alias("lines"), F.lit(1).alias("found"), F.create_map(F.lit("SRC"), F.col("addr")).alias("data"), F.array(F.lit("DEST")).alias("undefed"))
    before = rows.where("user_id % 7 = 0").select(F.col("event_id").alias("case_id"), F.lit("seen").alias("name"), F.col("addr").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(100 * DAY).alias("ttl"))
    return M.evaluate_scenes(cases, SCENE_RULES, ["daemon"], {"worked": ["seen"]}, before)


CHAIN_RULES = [
    M.Rule("probe", [r"probe from %%%%SRC%%%%$"], marks=[M.Mark("seen", ttl=DAY)]), M.Rule("knock", [r"knock from %%%%SRC%%%%$"], marks=[M.Mark("knocked", ttl=DAY)]),
    M.Rule("login", [r"login (?<ID>\S+) from %%%%SRC%%%%$"], marks=[M.Mark("inside", ttl=DAY)], track=[M.Track("session", ["ID"], ["SRC"], DAY)]),
    M.Rule("bye", [r"bye from %%%%SRC%%%%$"], marks=[M.Mark("knocked", lift=True)]),
    M.Rule("steal", [r"steal (?<ID>\S+)$"], track=[M.Track("session", ["ID"], [], DAY)], tracked=[M.Tracked("session", [P.Predicate("SRC", "exists")], ["SRC"])]),
]
CHAIN_READS = {"knock": ["seen"], "login": ["knocked"], "steal": ["inside"]}


@query(SQL + f""", l as (select *, lag(event_type, 1) over w as p1, lag(event_type, 2) over w as p2, (us - lag(us, 1) over w) // 1000000 as g1, (lag(us, 1) over w - lag(us, 2) over w) // 1000000 as g2 from h window w as (partition by user_id order by us, ord))
select r as rule, count(*) as cases, count(*) filter (case when p2 = 'click' and user_id % 5 <> 0 and g2 < {DAY} and g1 < {DAY} then 1 else 0 end = (event_type <> 'view')::int) as passed
from l, unnest(['login', 'steal']) as u(r) where p2 is not null group by r""")
def scene_chains(spark, sf):  # noqa: ANN001, ANN201
    """Scenes of five lines: three rules in a chain of marks, one that breaks it, and an offender that comes from another line's record."""
    order = Window.partitionBy("user_id").orderBy("us", "ord")
    back = {f"p{k}": F.lag("event_type", k).over(order) for k in (1, 2)} | {f"u{k}": F.lag("us", k).over(order) for k in (1, 2)}
    rows = hits(spark, sf).withColumns(back).where("p2 is not null").withColumn("addr", F.concat(F.lit("10.0.0."), F.col("user_id") % 200))
    line = lambda text, advance: F.named_struct(F.lit("message"), text, F.lit("daemon"), F.lit("d"), F.lit("advance"), advance.cast("long"))
    said = lambda verb: F.concat(F.lit(f"{verb} from "), "addr")
    name = F.concat(F.lit("s"), "event_id")
    scenes = F.array(
        line(F.when(F.col("p2") == "click", said("probe")).otherwise("noise"), F.lit(0)), line(said("knock"), F.expr("(u1 - u2) div 1000000")), line(F.when(F.col("user_id") % 5 == 0, said("bye")).otherwise("noise"), F.lit(0)),
        line(F.concat(F.lit("login "), name, F.lit(" from "), "addr"), F.expr("(us - u1) div 1000000")), line(F.concat(F.lit("steal "), name), F.lit(1)),
    )
    cases = rows.select(F.col("event_id").alias("case_id"), F.explode(F.array(F.lit("login"), F.lit("steal"))).alias("rule"), scenes.alias("lines"), (F.col("event_type") != "view").cast("int").alias("found"), F.create_map(F.lit("SRC"), F.col("addr")).alias("data"), F.array(F.lit("DEST")).alias("undefed"))
    cases = cases.withColumn("case_id", F.concat_ws(":", "case_id", "rule"))
    return M.evaluate_scenes(cases, CHAIN_RULES, ["daemon"], CHAIN_READS)


# --- counting


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf).select("bucket", F.col("user_id").alias("key"), "us", "ord", "w", "ip", "k", "event_type", "user_id")


@query(SQL + f"""select ord, user_id as key, (sum(w) over (partition by user_id order by us range between {DAY * 1_000_000 - 1} preceding and current row))::bigint as score from h""")
def sliding_score(spark, sf):  # noqa: ANN001, ANN201
    return C.sliding_score(_hits(spark, sf), DAY).select("ord", "key", "score")


@query(fold_sql("user_id", "1", DAY, 5) + "select 'kur:web' as bucket, key, us, ord, score from st where crossed")
def threshold_crossings(spark, sf):  # noqa: ANN001, ANN201
    """The flagship: which offenders reached the threshold, when."""
    return C.threshold_crossings(_hits(spark, sf).withColumn("w", F.lit(1).cast("long")), DAY, 5)


@query(fold_sql("user_id", "w", 2 * DAY, 12) + "select key, us, ord, score from st where crossed")
def weighted_crossings(spark, sf):  # noqa: ANN001, ANN201
    return C.threshold_crossings(_hits(spark, sf), 2 * DAY, 12).drop("bucket")


@query(SQL + """select case when event_type = 'view' then 'shadow:' else '' end || case when event_type = 'error' then 'rule:web:error' else 'kur:web' end as bucket, count(*) as n from h group by all""")
def bucket_choice(spark, sf):  # noqa: ANN001, ANN201
    b = C.bucket_choice(F.lit("web"), F.col("event_type"), F.col("event_type") == "error", F.col("event_type") == "view")
    return hits(spark, sf).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


SETTINGS = [("rule", "error", 3, None), ("watcher", "w1", None, 600), ("kur", "web", 9, 900), ("kur", "app", 7, None), ("global", "all", 10, 3600)]


@query(SQL + """select event_id, case when event_type = 'error' then 3 when k % 2 = 0 then 9 else 7 end as max_score, case when user_id % 3 = 1 then 600 when k % 2 = 0 then 900 else 3600 end as find_time from h""")
def effective_thresholds(spark, sf):  # noqa: ANN001, ANN201
    rows = hits(spark, sf).select("event_id", F.col("event_type").alias("rule"), F.concat(F.lit("w"), F.col("user_id") % 3).alias("watcher"), F.when(F.col("k") % 2 == 0, "web").otherwise("app").alias("kur"), F.lit("all").alias("global"))
    s = values(spark, "layer string, id string, max_score int, find_time int", SETTINGS)
    return C.effective_thresholds(rows, s, ["rule", "watcher", "kur", "global"], ["max_score", "find_time"]).select("event_id", "max_score", "find_time")


_FIND, _MOST = f"case when event_type = 'error' then {DAY // 4} when k % 2 = 0 then {2 * DAY} else {DAY} end", "case when event_type = 'error' then 3 when k % 2 = 0 then 6 else 5 end"


@query(fold_sql("user_id", "w", _FIND, _MOST) + "select key, us, ord, score, most as threshold, crossed from st")
def event_scores(spark, sf):  # noqa: ANN001, ANN201
    """The score of every hit with resets, where hits of one bucket race thresholds of their own: three find_times in it."""
    s = values(spark, "layer string, id string, max_score int, find_time int", [("rule", "error", 3, DAY // 4), ("kur", "even", 6, 2 * DAY), ("global", "all", 5, DAY)])
    rows = _hits(spark, sf).withColumns({"rule": F.col("event_type"), "kur": F.when(F.col("k") % 2 == 0, "even").otherwise("odd"), "global": F.lit("all")})
    return C.event_scores(C.effective_thresholds(rows, s, ["rule", "kur", "global"], ["max_score", "find_time"])).drop("bucket")


@query(fold_sql("user_id", "w", _FIND, _MOST) + "select key, us, ord, score from st where crossed")
def crossings_per_hit(spark, sf):  # noqa: ANN001, ANN201
    rows = _hits(spark, sf).withColumns({"find_time": F.expr(_FIND), "max_score": F.expr(_MOST)})
    return C.threshold_crossings(rows).drop("bucket")


@query(SQL + f""", q as (select user_id as key, us, ord, case when k % 7 = 0 then null when k % 7 = 1 then '' else (k % 10)::varchar end as of, row_number() over (partition by user_id order by us, ord) as n from h),
st as (with recursive st(key, n, live, us, ord, score, crossed) as (
  select distinct key, 0::bigint, []::struct(us bigint, of varchar)[], 0::bigint, 0::bigint, 0::bigint, false from q
  union all select key, n, live, us, ord, len(live), len(live) >= 4
  from (select st.key, q.n, q.us, q.ord, list_filter(case when st.crossed then [] else st.live end, lambda x: x.us > q.us - {2 * DAY * 1_000_000} and x.of <> coalesce(q.of, '')) || case when q.of <> '' then [{{'us': q.us, 'of': q.of}}] else [] end as live from st join q on q.key = st.key and q.n = st.n + 1)
) select * from st where n > 0)
select key, us, ord, score, crossed from st""")
def distinct_score(spark, sf):  # noqa: ANN001, ANN201
    """One hit in seven has no value, one an empty one."""
    return C.distinct_scores(_hits(spark, sf).withColumn("of", _seldom((F.col("k") % 10).cast("string"))), 2 * DAY, 4).drop("bucket")


def _seldom(value: Column) -> Column:
    return F.when(F.col("k") % 7 == 0, F.lit(None)).when(F.col("k") % 7 == 1, "").otherwise(value)


#: Counted by a value that for three keys of nine is now and then the offender itself.
VALUES_SQL = SQL + f""", q as (select concat('a', user_id % 9) as key, us, ord, case when k % 7 = 0 then null when k % 7 = 1 then '' else ip end as of, case when user_id % 9 < 3 and k % 5 = 0 then concat('a', user_id % 9) else ip end as offender,
    row_number() over (partition by user_id % 9 order by us, ord) as n from h),
st as (with recursive st(key, n, live, us, ord, offender, score, emptied) as (
  select distinct key, 0::bigint, map()::map(varchar, bigint), 0::bigint, 0::bigint, '', 0::bigint, false from q
  union all select key, n, live, us, ord, offender, cardinality(live)::bigint, cardinality(live) >= 30 and key = offender
  from (select st.key, q.n, q.us, q.ord, q.offender, map_from_entries(list_filter(map_entries(case when st.emptied then map()::map(varchar, bigint) else st.live end), lambda x: x.value > q.us - {DAY * 1_000_000} and x.key <> coalesce(q.of, ''))
          || case when q.of <> '' then [{{'key': q.of, 'value': q.us}}] else [] end) as live from st join q on q.key = st.key and q.n = st.n + 1)
) select * from st where n > 0 and score >= 30)
select key, us, ord, offender, score from st"""


def _value_hits(rows: DataFrame) -> DataFrame:
    key = F.concat(F.lit("a"), F.col("user_id") % 9)
    offender = F.when((F.col("user_id") % 9 < 3) & (F.col("k") % 5 == 0), key).otherwise(F.col("ip"))
    return rows.withColumns({"key": key, "of": _seldom(F.col("ip")), "offender": offender})


@query(VALUES_SQL)
def value_count(spark, sf):  # noqa: ANN001, ANN201
    return C.value_counts(_value_hits(hits(spark, sf)), DAY, 30).drop("bucket")


@query(fold_sql(MIXED_NET_SQL, "w", DAY, 30, member=MIXED_SQL) + """select key as cidr, us, ord, score, len(live) as hits, live[1].us as first, us as last,
    array_to_string(list_transform(list_sort(list_transform(list_distinct(list_transform(live, lambda x: x.member)), lambda m: {'p': list_position(list_transform(live, lambda x: x.member), m), 'm': m})), lambda x: x.m), ',') as members from st where crossed""")
def subnet_score(spark, sf):  # noqa: ANN001, ANN201
    rows = hits(spark, sf).select("bucket", _mixed("ip", "event_id").alias("key"), "us", "ord", "w")
    return C.subnet_crossings(rows, 24, DAY, 30, prefix_v6=48).drop("bucket").withColumn("members", F.array_join("members", ","))


@query(fold_sql("user_id", "1", DAY, 5) + f"""select ord, us, key, times as n from (select *, count(*) over (partition by key order by us range between {7 * DAY * 1_000_000 - 1} preceding and current row) as times from st where crossed) where times >= 2""")
def recidive(spark, sf):  # noqa: ANN001, ANN201
    bans = threshold_crossings(spark, sf).select("ord", "us", F.lit("web").alias("kur"), F.col("key").alias("ip"))
    return C.recidive(bans, 7 * DAY, 2).select("ord", "us", F.col("ip").alias("key"), F.col("count").alias("n"))


@query(fold_sql("user_id", "1", DAY, 5) + f""", t as (select max(us) - 5 * {DAY * 1_000_000} as t from h), c as (select key, max(us) as cus from st, t where crossed and us <= t group by key),
o as (select h.user_id as key, h.event_type as rule, h.us, t.t from h join t on h.us <= t.t left join c on c.key = h.user_id where cus is null or h.us > cus),
l as (select *, max(us) over (partition by key) as last_us from o),
f as (select * from l where last_us - us < {DAY * 1_000_000} and t - last_us <= {DAY * 1_000_000})
select key, rule, count(*) as hits, count(*) as score, min(us) as first, max(us) as last from f group by grouping sets ((key), (key, rule))""")
def accused(spark, sf):  # noqa: ANN001, ANN201
    rows = _hits(spark, sf).withColumn("w", F.lit(1).cast("long"))
    at = rows.agg(F.max("us")).head()[0] - 5 * DAY * 1_000_000
    return C.accused(rows.withColumn("rule", F.col("event_type")), threshold_crossings(spark, sf), DAY, at).drop("bucket")


@query(SQL + f"select bucket, count(distinct {MIXED_SQL}) as offenders, count(distinct {MIXED_NET_SQL}) as subnets from h group by bucket")
def tracked_counts(spark, sf):  # noqa: ANN001, ANN201
    return C.tracked_counts(hits(spark, sf).select("bucket", _mixed("ip", "event_id").alias("key")), prefix_v6=48)


@query(SQL + f""", l as (select user_id as key, us, ord, ip, k, case event_type when 'click' then 'try' when 'purchase' then 'in' end as stage, row_number() over (partition by user_id order by us, ord) as n from h),
st as (with recursive st(key, n, us, ord, c, seen, last, done, ip) as (
  select distinct key, 0::bigint, 0::bigint, 0::bigint, 0, '', 0::bigint, false, '' from l
  union all
  select key, n, us, ord, case when is_done then 0 when adv1 or advance then case when adv1 then 1 else c0 + 1 end else c0 end, case when adv1 or advance then k::varchar else seen0 end, case when adv1 or advance then us else last0 end, is_done, ip
  from (select *, c0 < 2 and stage = 'try' and c0 > 0 as advance, c0 = 0 and stage = 'try' as adv1, c0 = 2 and coalesce(stage = 'in', false) as is_done
        from (select l.key, l.n, l.us, l.ord, l.ip, l.k, coalesce(l.stage, '') as stage, st.last as last0, st.seen as seen0, case when st.c > 0 and l.us - st.last >= {2 * DAY * 1_000_000} then 0 else st.c end as c0 from st join l on l.key = st.key and l.n = st.n + 1))
) select * from st)
select key, us, ord, 3 as n_hits, seen as k, ip from st where done""")
def staged_sequence(spark, sf):  # noqa: ANN001, ANN201
    """Captures merge: of ``ip``, which all lines have, the last; ``k`` is that of the last try."""
    stage = F.when(F.col("event_type") == "click", "try").when(F.col("event_type") == "purchase", "in")
    data = F.create_map(F.lit("ip"), F.col("ip"), F.lit("k"), F.when(F.col("event_type") == "click", F.col("k").cast("string")))
    rows = hits(spark, sf).select(F.col("user_id").alias("key"), "us", "ord", stage.alias("stage"), data.alias("data"))
    got = ST.staged_sequence(rows, [ST.Stage("try", 2, 2 * DAY), ST.Stage("in", 1, 2 * DAY)])
    return got.select("key", "us", "ord", F.size("hits").alias("n_hits"), F.try_element_at("data", F.lit("k")).alias("k"), F.try_element_at("data", F.lit("ip")).alias("ip"))


# --- events and reports


def _events(spark: SparkSession, sf: str) -> DataFrame:
    rows = _hits(spark, sf).withColumn("w", F.lit(1).cast("long"))
    return _classified(rows, C.event_scores(rows, DAY, 5))


def _classified(rows: DataFrame, scores: DataFrame) -> DataFrame:
    return E.scored_events(rows.withColumnRenamed("event_type", "rule"), scores, F.col("rule") == "view", F.col("rule") == "click")


EVENTS_SQL = fold_sql("user_id", "1", DAY, 5) + """, e as (select h.ord, h.user_id as key, h.ip, h.us, h.event_type as rule, h.k, s.crossed, s.most as threshold, s.score,
    case when h.event_type = 'view' then case when s.crossed then 'sighted' else 'sighting' end when h.event_type = 'click' then case when s.crossed then 'alert' else 'noted' end
         else case when s.crossed then 'banish' else 'found' end end as event_type
    from h join st s on s.key = h.user_id and s.ord = h.ord)
"""


@query(EVENTS_SQL + "select ord, key, rule, event_type, score, threshold from e")
def classify_event(spark, sf):  # noqa: ANN001, ANN201
    return _events(spark, sf).select("ord", "key", "rule", "event_type", "score", "threshold")


META = [("error", "attempted-recon", 2), ("view", "weird-newThing", None), ("click", None, 4)]


@query(SQL + f""", m as (select * from {literal(META, 'rule, classtype, severity')})
select event_id, coalesce(m.severity, 5) as severity, case m.classtype when 'attempted-recon' then 'Attempted Information Leak' when 'weird-newThing' then 'Weird NewThing' end as category,
    ('0x' || md5(event_type)[1:8])::bigint & 2147483647 as sid from h left join m on m.rule = event_type""")
def triage(spark, sf):  # noqa: ANN001, ANN201
    rows = E.triage(hits(spark, sf).withColumn("rule", F.col("event_type")), values(spark, "rule string, classtype string, severity int", META))
    return rows.select("event_id", E.effective_severity(F.col("severity"), F.lit(5)).alias("severity"), "category", "sid")


SLUGS = ["bad-unknown", "policy-violation", "shellcode-detect", "denial-of-service", "misc-activity", "unsuccessful-admin", "own--slug-", None]


@query(SQL + """select event_id, (['Potentially Bad Traffic', 'Potential Corporate Privacy Violation', 'Executable code was detected', 'Detection of a Denial of Service Attack',
    'Misc activity', 'Unsuccessful Administrator Privilege Gain', 'Own Slug', null])[user_id % 8 + 1] as category from h""")
def category(spark, sf):  # noqa: ANN001, ANN201
    slug = F.element_at(F.array(*map(F.lit, SLUGS)), (F.col("user_id") % 8 + 1).cast("int"))
    return hits(spark, sf).select("event_id", S.category(slug).alias("category"))


@query(SQL + """select event_id, ip as src_ip, null::varchar as dest_ip, dayofweek(make_timestamp(us))::int as weekday, hh * 100 + mi as hhmm, 'ok' || chr(65533) as scrubbed, event_id % 17 <> 0 as is_json from h""")
def event_fields(spark, sf):  # noqa: ANN001, ANN201
    rows = lines(spark, sf, "json")
    found = F.create_map(F.lit("SRC"), F.col("ip"))
    at = S.time_fields(F.col("sec").cast("string"))
    bad = F.concat(F.lit("ok").cast("binary"), F.unhex(F.lit("FF")))
    structure = F.schema_of_variant(S.raw_as_json(F.col("line"))).startswith("OBJECT")
    return rows.select("event_id", *_ends(found), at["weekday"].alias("weekday"), at["hhmm"].alias("hhmm"), S.scrub_utf8(bad).alias("scrubbed"), structure.alias("is_json"))


def _ends(found):  # noqa: ANN001, ANN202
    ends = S.flow_endpoints(found, "SRC", "DEST")
    return [ends["src_ip"].alias("src_ip"), ends["dest_ip"].alias("dest_ip")]


@query(EVENTS_SQL + """, s as (select concat('w', key % 3) as watcher, rule, ord % 17 <> 0 as parsed, k > 10 as matched, k > 90 as ignored, event_type, 1 + k % 3 as n_lines, rule = 'click' as demoted, crossed and k % 2 = 0 as subnet_ban, event_type = 'banish' and k % 5 = 0 as recidivist from e)
select watcher, rule, grouping(watcher, rule)::int as level, count(*) as lines, count(*) filter (not parsed) as unparsed, count(*) filter (matched) as matched, count(*) filter (ignored) as ignored,
    count(*) filter (event_type = 'banish') as bans, count(*) filter (event_type = 'alert') as alerts, count(*) filter (event_type in ('sighting', 'sighted')) as sightings, count(*) filter (event_type = 'noted') as noted,
    count(*) filter (n_lines > 1) as joined, count(*) filter (demoted) as demoted, count(*) filter (subnet_ban) as subnet_bans, count(*) filter (recidivist) as recidivists
from s group by grouping sets ((), (watcher), (rule))""")
def stats(spark, sf):  # noqa: ANN001, ANN201
    rows = _events(spark, sf).select(F.concat(F.lit("w"), F.col("key") % 3).alias("watcher"), "rule", (F.col("ord") % 17 != 0).alias("parsed"), (F.col("k") > 10).alias("matched"), (F.col("k") > 90).alias("ignored"), "event_type",
        (1 + F.col("k") % 3).alias("n_lines"), (F.col("rule") == "click").alias("demoted"), (F.col("crossed") & (F.col("k") % 2 == 0)).alias("subnet_ban"), ((F.col("event_type") == "banish") & (F.col("k") % 5 == 0)).alias("recidivist"))
    return R.stats(rows)


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return threshold_crossings(spark, sf).select((F.col("us") / 1_000_000).cast("long").alias("epoch"), F.concat(F.lit("kur"), F.col("key") % 3).alias("kur"), F.col("key").cast("string").alias("ip"), "ord", F.when(F.col("key") % 5 == 0, 0).when(F.col("key") % 5 == 1, 3 * DAY).alias("ban_time"))


LEDGER_SQL = fold_sql("user_id", "1", DAY, 5) + f""", g as (select us // 1000000 as epoch, concat('kur', key % 3) as kur, key::varchar as ip, ord, case when key % 5 = 0 then 0 when key % 5 = 1 then {3 * DAY} end as ban_time from st where crossed),
now as (select max(us) // 1000000 as t from h),
held as (select kur, ip, bool_or(coalesce(ban_time, {DAY}) = 0) as forever, max(epoch + coalesce(ban_time, {DAY})) as until from g group by kur, ip)
"""


def _now(spark: SparkSession, sf: str) -> int:
    return hits(spark, sf).agg(F.max("sec")).head()[0]


@query(LEDGER_SQL + f"select epoch, kur, ip, ord from g, now where kur = 'kur1' and epoch >= t - {7 * DAY} order by epoch desc, ord desc limit 20")
def ledger_query(spark, sf):  # noqa: ANN001, ANN201
    return R.ledger_query(_ledger(spark, sf), kur="kur1", since="7d", now=_now(spark, sf), tail=20).drop("ban_time")


@query(LEDGER_SQL + "select kur, ip, case when not forever then until end as expires from held, now where forever or until > t")
def active_bans(spark, sf):  # noqa: ANN001, ANN201
    return R.active_bans(_ledger(spark, sf), _now(spark, sf), DAY)


@query(LEDGER_SQL + """, a as (select kur, ip from held, now where forever or until > t), o as (select kur, count(distinct ip) as banned from a group by kur)
select * from o where kur <> 'kur2' union all select 'kur2', count(distinct ip) from a where kur in ('kur0', 'kur1') union all select '', coalesce(sum(banned), 0)::bigint from o""")
def ban_tally(spark, sf):  # noqa: ANN001, ANN201
    return R.ban_tally(active_bans(spark, sf), values(spark, "gate string, kur string", [("kur2", "kur0"), ("kur2", "kur1")]))


def _report_events(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_type", "ip", F.when(F.col("k") % 10 != 0, F.col("ip")).alias("src"), F.lit("unknown").alias("host"), "score", "threshold", "ord", "key")


@query(EVENTS_SQL + "select case when k % 10 <> 0 then ip else 'unknown' end as offender, count(*) as n from e where event_type in ('found', 'banish') group by 1 order by n desc, offender limit 10")
def busiest_offenders(spark, sf):  # noqa: ANN001, ANN201
    return R.busiest_offenders(_report_events(spark, sf))


@query(EVENTS_SQL + """select distinct event_type, ip from e where event_type in ('banish', 'alert', 'sighted')""")
def banishments(spark, sf):  # noqa: ANN001, ANN201
    ev = _report_events(spark, sf)
    return R.distinct_subjects(ev, "banish", ["event_type", "ip"]).unionByName(R.distinct_subjects(ev, "alert", ["event_type", "ip"])).unionByName(R.distinct_subjects(ev, "sighted", ["event_type", "ip"]))


@query(EVENTS_SQL + "select ord, event_type, ip from e where ip = '10.1.1.2'")
def offender_history(spark, sf):  # noqa: ANN001, ANN201
    return R.offender_history(_report_events(spark, sf), "10.1.1.2").select("ord", "event_type", "ip")


@query(EVENTS_SQL + "select distinct ip, score, threshold, score / threshold::double as ratio from e where event_type = 'found'")
def closest_to_ban(spark, sf):  # noqa: ANN001, ANN201
    return R.closest_to_ban(_report_events(spark, sf))
