"""Lines as long as their senders like: every parser and matcher takes them whole, in time linear in their length."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import parse, predicates

LONG = 1_000_000
TIME, ACCESS, NGINX = "Oct 11 22:14:15", '1.2.3.4 - - [x] "GET {} HTTP/1.1" 200 5 "-" "{}"', "2024/01/01 00:00:00 [error] 7#0: *3 "
FILLS = {"plain": "a" * LONG, "escapes": 'x\\"' * (LONG // 3), "commas": ", a" * (LONG // 3), "dots": "label." * (LONG // 6), "opens": '="' * (LONG // 2), "pairs": ", client: x" * (LONG // 11), "blanks": " " * LONG}


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).head().x


@pytest.mark.parametrize("fill", FILLS)
def test_parsers(spark, fill):
    text = FILLS[fill]
    quoted = text if fill in ("escapes", "plain", "commas", "dots", "pairs", "blanks") else "y"
    began = time.perf_counter()
    assert one(spark, f"{TIME} h d[1]: {text}", parse.parse_bsd_syslog).message == text
    assert one(spark, f'<13>1 t h d 1 - [a b="{quoted}"][c] {text}', parse.parse_ietf_syslog).message == text
    assert one(spark, f'<13>1 t h d 1 - [a b="{quoted}"][c] {text}', parse.parse_syslog_any).message == text
    r = one(spark, ACCESS.format("/" + quoted.replace(" ", "+"), quoted), parse.parse_http_access)
    assert (r.path, r.user_agent) == ("/" + quoted.replace(" ", "+"), quoted)
    assert one(spark, ACCESS.format("/", quoted)[:-1], parse.parse_http_access) is None
    assert one(spark, f"[Wed Oct 11 14:32:52 2000] [error] [client 1.2.3.4] {text}", parse.parse_apache_error).message == text
    r = one(spark, f'{NGINX}m, client: 1.2.3.4, request: "{quoted}", host: "h"', parse.parse_nginx_error)
    assert (r.client, r.request, r.host, r.message) == ("1.2.3.4", quoted, "h", "m")
    r = one(spark, f"{NGINX}m{text}, server: s", parse.parse_nginx_error)
    assert (r.server, r.client) == ("s", "x" if fill == "pairs" else None)
    m = one(spark, f'a=1 b="{quoted}" c=2', parse.parse_key_value)
    assert (m["b"], m["c"]) == (quoted, "2")
    assert "z" in one(spark, f"{text} z=1", parse.parse_key_value)
    assert time.perf_counter() - began < 120


@pytest.mark.parametrize("fill", ["plain", "dots", "blanks"])
def test_matchers(spark, fill):
    text = FILLS[fill]
    began = time.perf_counter()
    every = lambda t: F.struct(*(c.alias(name) for name in predicates.TOKENS for c in predicates.extract_tokens(t, f" %%%%{name}%%%% nothing").values()))
    assert not any(one(spark, f"x {text} y", every))
    r = one(spark, f"{text} bad from 1.2.3.4", lambda t: predicates.first_match(t, [r"^%%%%DNS%%%%$", r"bad from %%%%SRC%%%%$"]))
    assert (r.pattern, r.SRC) == (1, "1.2.3.4")
    assert one(spark, f"{text} bad", lambda t: predicates.ignored(t, [r"\bbad$"])) is True
    assert time.perf_counter() - began < 120


@pytest.mark.parametrize(("tail", "want"), [
    (', client: 1.1.1.1, request: "a, client: b", host: "h"', ("1.1.1.1", "a, client: b", "h", "m")),
    (', client: "b", server: s', ("b", None, None, "m")), (', client: a, client: b', ("b", None, None, "m")),
    (', request: "open, client: 1.1.1.1, host: "h"', ("1.1.1.1", None, "h", 'm, request: "open')),
    (r', request: "a\", client: 6.6.6.6", client: 1.1.1.1', ("1.1.1.1", r"a\", client: 6.6.6.6", None, "m")),
    (', client: a, b', (None, None, None, "m, client: a, b")), (', client: "a" b', (None, None, None, 'm, client: "a" b')), (', host: ', (None, None, None, "m")), ("", (None, None, None, "m")),
])
def test_nginx_tails(spark, tail, want):
    r = one(spark, f"{NGINX}m{tail}", parse.parse_nginx_error)
    assert (r.client, r.request, r.host, r.message) == want


def test_access_ends(spark):
    line = '1.2.3.4 - - [x] "GET / HTTP/1.1" 200 5 "-" "a"'
    assert one(spark, f"  {line}  ", parse.parse_http_access).user_agent == "a"
    assert one(spark, line.replace(" ", "\t", 1), parse.parse_http_access).host == "1.2.3.4"
    for bad in (line + " x", line[:-1], line + ' "b"', line.replace(' "a"', ""), line.replace("200", "20")):
        assert one(spark, bad, parse.parse_http_access) is None


@pytest.mark.parametrize(("pattern", "text"), [
    ("a|b", ""), ("(?i)abc", ""), ("ab+c", "a"), (r"x(foo|bar)y\.z", "y.z"), ("[abc]de[^]]f", "de"), (r"^\S+ sshd\[", " sshd["), ("abc?", "ab"), (r"ab{2}cde", "cde"), (r"\Qa.b\E", ""), (r"a\x41b", ""), ("", ""),
    ("[[a]b]cd", ""), ("(?:ab)+cd", "cd"), ("a(b(c|d)e)f", "a"),
])
def test_needed_text(pattern, text):
    assert predicates.needed_text(pattern) == text


@pytest.mark.parametrize(("net", "ip", "want"), [
    ("10.0.0.0/8", "10.1.2.3", True), ("10.0.0.0/8", "11.1.2.3", False), ("2001:db8::/32", "2001:db8::1", True), ("2001:db8::/32", "2001:db9::1", False), ("2001:db8::1", "2001:DB8:0::1", True),
    ("10.1.2.3", "::ffff:10.1.2.3", True), ("0.0.0.0/0", "1.2.3.4", True), ("::/0", "::2", True), ("::/0", "1.2.3.4", False), ("10.0.0.0/33", "10.0.0.0", False), ("2001:db8::/x", "2001:db8::", False),
    ("10.0.0.0/8/8", "10.0.0.0", False), (None, "1.2.3.4", False), ("10.0.0.0/8", None, False), ("junk", "junk", False), ("::ffff:10.0.0.0/8", "10.1.1.1", True),
])
def test_network_of_a_field(spark, net, ip, want):
    df = spark.createDataFrame([(net, ip)], "net string, ip string")
    p = predicates.Predicate("ip", "cidr", ["net"], fieldref=True)
    assert df.select(p.column({"ip": F.col("ip"), "net": F.col("net")}).alias("x")).head().x is want
