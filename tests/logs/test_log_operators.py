"""Edge rules of the operators, and sequential models against the Spark jobs on random streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import parse, predicates, scalars
from tidewatch.functions.ip import addr_equal, ip_family, ip_in_any, ip_network, v6_canonical, v6_key, v6_network
from tidewatch.operators import gates, match, reports, score, stages, state
from tidewatch.operators.common import SECOND
from tidewatch.sources import logs

HITS = "bucket string, key string, us long, ord long, w long, of string, offender string"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).head().x


def stream(n, keys=5, span=4000, seed=0):
    rng = random.Random(seed)
    times = sorted(rng.randrange(span) for _ in range(n))
    return [("b", f"k{rng.randrange(keys)}", t * SECOND, k, rng.randint(1, 3), f"v{rng.randrange(6)}", f"o{rng.randrange(9)}") for k, t in enumerate(times)]


# --- parsing


@pytest.mark.parametrize(("line", "want"), [
    ("<34>Oct  1 22:14:15 web su[77]: failed: x", ("web", "su", "77", "auth", 2, "failed: x")),
    ("Oct 11 22:14:15 su: no host: here", (None, "su", None, None, None, "no host: here")),
    ("2024-01-02T03:04:05.6+00:00 2001:db8::1 sshd[1:2]: m", ("2001:db8::1", "sshd", "1", None, None, "m")),
    ("<auth.err>Oct 11 22:14:15 h d: m", ("h", "d", None, "auth", 3, "m")),
    ("<192>Oct 11 22:14:15 h d: m", None), ("no syslog", None), ("", None), (None, None),
])
def test_bsd(spark, line, want):
    r = one(spark, parse.parse_bsd_syslog(F.lit(line).cast("string")))
    assert (None if r is None else (r.hostname, r.daemon, r.pid, r.facility, r.severity, r.message)) == want


def test_other_parsers(spark):
    r = one(spark, parse.parse_ietf_syslog(F.lit('<165>1 2003-10-11T22:14:15.003Z - app - ID47 [a b="]\\"x"][c]')))
    assert (r.hostname, r.daemon, r.pid, r.severity, r.message) == (None, "app", None, 5, "")
    r = one(spark, parse.parse_http_access(F.lit(r'1.2.3.4 - - [x] "GET /a\"b" 200 - "r" "a\"g"')))
    assert (r.method, r.path, r.protocol, r.bytes, r.user_agent, r.format) == ("GET", r"/a\"b", None, None, r"a\"g", "combined")
    r = one(spark, parse.parse_apache_error(F.lit("[Wed Oct 11 14:32:52 2000] [error] [client 2001:db8::1] denied")))
    assert (r.client, r.client_port, r.module, r.message) == ("2001:db8::1", None, None, "denied")
    assert one(spark, parse.parse_journal(F.lit('{"MESSAGE": ""}'))).message == ""
    assert one(spark, parse.parse_journal(F.lit('{"_COMM": "x"}'))) is None
    assert one(spark, parse.flatten_json(F.lit('{"a": {"b": [1, true, null]}, "c": 1.5}'))) == {"a.b.0": "1", "a.b.1": "1", "c": "1.5"}
    assert one(spark, parse.flatten_json(F.lit("[1]"))) is None


# --- predicates


@pytest.mark.parametrize(("predicate", "want"), [
    (predicates.Predicate("n", "gt", ["4"]), True), (predicates.Predicate("n", "gt", ["5.0"]), False), (predicates.Predicate("word", "gt", ["1"]), False),
    (predicates.Predicate("gone", "eq", ["x"]), False), (predicates.Predicate("gone", "eq", ["x"], negate=True), True), (predicates.Predicate("gone", "exists"), False),
    (predicates.Predicate("word", "re", ["^A.C$"], nocase=True), True), (predicates.Predicate("word", "re", ["^A.C$"]), False),
    (predicates.Predicate("word", "startswith", ["a", "b"], all=True), False), (predicates.Predicate("url", "contains", ["../"], decode=["url"]), True),
    (predicates.Predicate("url", "contains", ["+ "], decode=["url"]), False), (predicates.Predicate("dash", "eq", ["-x"], decode=["windash"]), True),
    (predicates.Predicate("six", "cidr", ["10.0.0.0/8", "2001:db8::/32"]), True), (predicates.Predicate("ip", "cidr", ["2001:db8::/32", "junk"]), False),
    (predicates.Predicate("coded", "contains", ["needle"], decode=["base64offset"]), True), (predicates.Predicate("wide", "contains", ["ne"], decode=["wide"]), True),
    (predicates.Predicate("word", "contains", ["ne"], decode=["wide"]), False),
    (predicates.Predicate("ip", "cidr", ["10.0.0.0/8"]), True), (predicates.Predicate("word", "cidr", ["10.0.0.0/8"]), False),
])
def test_predicate(spark, predicate, want):
    of = {"n": F.lit("5"), "word": F.lit("abc"), "url": F.lit("a+%2e%2e%2f"), "dash": F.lit("–x"), "ip": F.lit("::ffff:10.1.2.3"), "six": F.lit("2001:DB8:0::9"), "coded": F.lit("eG5lZWRsZSBoZXJl"), "wide": F.lit("n\x00e\x00")}
    assert one(spark, predicate.column(of)) is want


@pytest.mark.parametrize(("text", "steps", "want"), [
    ("needle", ["base64"], True), ("", ["base64", "utf16"], False), ("!!", ["base64", "lower"], False), ("needle", ["utf16", "base64"], True), ("needle", ["utf16be", "base64"], True),
    ("NEEDLE", ["base64", "lower"], True), ("NEEDLE", ["base64"], False),
])
def test_decode_chains(spark, text, steps, want):
    import base64

    value = text
    for step in reversed([s for s in steps if s != "lower"]):
        if step == "base64":
            value = base64.b64encode(value.encode()).decode() if text.isalpha() else value
        else:
            value = "".join((c + "\0") if step == "utf16" else ("\0" + c) for c in value)
    p = predicates.Predicate("v", "contains", ["needle"], decode=[s.removesuffix("be") for s in steps])
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(p.column({"v": F.col("v")}).alias("x")).head().x is want


def test_conditions(spark):
    sel = {"a1": F.lit(True), "a2": F.lit(False), "b": F.lit(True)}
    assert one(spark, predicates.condition("a1 and (a2 or b) and not a2", sel)) is True
    assert one(spark, predicates.condition("all of a*", sel)) is False
    for bad in ("", "3 of a*", "all of z*", "a1 and", "(a1", "zz"):
        with pytest.raises(ValueError):
            predicates.condition(bad, sel)
    with pytest.raises(ValueError):
        predicates.checked_regex(r"a\Kb")
    assert all(f in "x" + __import__("base64").b64encode(b"0" * k + b"needle here").decode() for k, f in enumerate(predicates.needle_forms("needle", "base64offset")))


# --- addresses and scalars


@pytest.mark.parametrize(("ip", "family", "net"), [("1.2.3.4", "v4", "1.2.3.0/24"), ("::ffff:1.2.3.4", "v4", "1.2.3.0/24"), ("2001:DB8::1", "v6", "2001:d00::/24"), ("256.1.1.1", None, None), ("x", None, None), (None, None, None)])
def test_addresses(spark, ip, family, net):
    row = spark.createDataFrame([(ip,)], "ip string").select(ip_family(F.col("ip")).alias("f"), ip_network(F.col("ip"), F.lit(24)).alias("n")).head()
    assert (row.f, row.n) == (family, net)


def test_six_is_the_standard_library(spark):
    import ipaddress

    rng = random.Random(5)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2:3:4:5:6:7", ":::", "12345::", "g::", "64:ff9b::1.2.3.4", "::1.2.3.4", "::ffff:1.2.3.4", "::ffff:0:1", "::1.2.3.256", "1.2.3.4::", "fe80::1%eth0", "", ":", "0:0:1:0:0:0:1:0", "0:0:0:1:0:0:0:1", "1:0:0:2:0:0:3:0", "A::B"]
    for _ in range(400):
        groups = [rng.choice(["0", "0", "0000", f"{rng.randrange(65536):x}", f"{rng.randrange(256):04X}"]) for _ in range(8)]
        at, n = rng.randrange(8), rng.randrange(1, 8)
        texts.append(":".join(groups) if rng.random() < 0.4 else ":".join(groups[:at]) + "::" + ":".join(groups[at + n :]))
    rows = [(t, 1 + k % 128) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "ip string, p int").select("ip", "p", v6_key(F.col("ip")).alias("key"), v6_canonical(F.col("ip")).alias("text"), v6_network(F.col("ip"), F.col("p")).alias("net"))
    for r in df.collect():
        try:
            a = ipaddress.IPv6Address(r.ip)
            a = None if a.ipv4_mapped or a.scope_id else a
        except ValueError:
            a = None
        want = (None,) * 3 if a is None else (a.packed.hex(), str(a), str(ipaddress.ip_network((a, r.p), strict=False)))
        assert (r.key, r.text, r.net) == want, r.ip


def test_membership_of_both_families(spark):
    rows = spark.createDataFrame([("10.1.2.3",), ("2001:db8::5",), ("::ffff:10.1.9.9",), ("9.9.9.9",), ("host",), (None,)], "ip string")
    nets = spark.createDataFrame([("10.1.0.0/16",), ("2001:db8::/32",), ("bad",)], "cidr string")
    assert [r.on for r in ip_in_any(rows, "ip", nets, "on", with_v6=True).orderBy(F.desc_nulls_last("on"), "ip").collect()] == [True] * 3 + [False] * 3
    same = spark.createDataFrame([("2001:db8::1", "2001:0db8:0:0::1"), ("1.2.3.4", "::ffff:1.2.3.4"), ("x", "x")], "a string, b string")
    assert [r.e for r in same.select(addr_equal(F.col("a"), F.col("b")).alias("e")).collect()] == [True, True, False]


def test_gates_know_both_families(spark):
    rows = spark.createDataFrame([("10.1.2.3",), ("10.9.0.1",), ("2001:db8::5",), ("2001:DB8:0:0::6",), ("2001:db9::1",), ("host",)], "ip string")
    nets = spark.createDataFrame([("10.1.0.0/16",), ("2001:db8::/32",)], "cidr string")
    left = ["10.9.0.1", "2001:db9::1", "host"]
    assert sorted(r.ip for r in gates.drop_ignored(rows, nets).collect()) == left
    assert sorted(r.ip for r in gates.ban_not_internal(rows, nets).collect()) == left
    assert sorted(r.ip for r in gates.blocklist_gate(rows, [("ip", [nets], "cidr")]).collect()) == ["10.1.2.3", "2001:DB8:0:0::6", "2001:db8::5"]


def test_scalars(spark):
    assert one(spark, scalars.category(F.lit("odd-newThing"))) == "Odd NewThing"
    assert one(spark, scalars.sid(F.lit("abc"))) == int(__import__("hashlib").md5(b"abc").hexdigest()[:8], 16) & 0x7FFFFFFF
    t = one(spark, scalars.time_fields(F.lit("1704067200000")))
    assert (t.weekday, t.hhmm) == (1, 0)
    assert one(spark, scalars.time_fields(F.lit("2024-01-06T23:59:01.5+09:00"))).asDict() == {"weekday": 6, "hhmm": 2359}
    assert one(spark, scalars.time_fields(F.lit("noon"))) is None
    assert one(spark, gates.active_time(F.lit("noon"), [{}], negate=True)) is False


# --- counting against sequential models


@pytest.mark.parametrize("seed", range(4))
def test_crossings(spark, seed):
    rows, find, most = stream(400, seed=seed), 300, 9
    live, want = {}, []
    for b, k, us, o, w, *_ in rows:
        mine = [x for x in live.get(k, []) if us - x[0] < find * SECOND] + [(us, w)]
        s = sum(x[1] for x in mine)
        if s >= most:
            want.append((b, k, us, o, s))
            mine = []
        live[k] = mine
    df = spark.createDataFrame(rows, HITS)
    assert sorted(map(tuple, score.threshold_crossings(df, find, most).collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_sliding_and_distinct_and_values(spark, seed):
    rows, find = stream(300, span=900, seed=seed), 100
    df = spark.createDataFrame(rows, HITS)
    got = {r.ord: r.score for r in score.sliding_score(df, find).collect()}
    assert got == {o: sum(x[4] for x in rows[: o + 1] if x[1] == k and us - x[2] < find * SECOND) for _, k, us, o, *_ in rows}
    seen, want = {}, {}
    for _, k, us, o, _, of, _ in rows:
        mine = {v: t for v, t in seen.get(k, {}).items() if us - t < find * SECOND} | {of: us}
        want[o] = (len(mine), len(mine) >= 4)
        seen[k] = {} if len(mine) >= 4 else mine
    assert {r.ord: (r.score, r.crossed) for r in score.distinct_scores(df, find, 4).collect()} == want
    over = {o: n for _, k, us, o, _, _, off in rows if (n := len({x[5] for x in rows[: o + 1] if x[1] == k and us - x[2] < find * SECOND})) >= 3}
    assert {r.ord: r.score for r in score.value_counts(df, find, 3).collect()} == over


@pytest.mark.parametrize("seed", range(3))
def test_marks_and_tracks(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(3)}", t * SECOND, o, rng.choice(["set", "unset", "probe", "probe"]), f"v{rng.randrange(2)}", rng.choice([20, 60])) for o, t in enumerate(sorted(rng.randrange(900) for _ in range(250)))]
    store, want = {}, {}
    for k, us, o, op, v, ttl in rows:
        m = store.get(k)
        live = m is not None and m[0] > us
        if op == "probe":
            want[o] = (m[1], m[2]) if live else None
        elif op == "unset":
            store.pop(k, None)
        else:
            store[k] = (us + ttl * SECOND, v, m[2] if live else us)
    df = spark.createDataFrame(rows, "key string, us long, ord long, op string, value string, ttl int").withColumn("name", F.lit("m"))
    got = {r.id: (r.value, r.first_set) for r in state.as_of_marks(df.where("op = 'probe'").withColumn("id", F.col("ord")), df.where("op <> 'probe'")).collect()}
    assert got == {o: x for o, x in want.items() if x}
    rec, after = {}, {}
    for k, us, o, op, v, _ in rows:
        live = k in rec and us - rec[k][0] < 60 * SECOND
        before = rec[k][1] if live else None
        value = v if op == "set" else None
        if op != "probe":
            rec[k] = (us, value if value is not None else before)
        after[o] = (live, before, rec[k][1] if op != "probe" or live else None)
    tracks = state.tracks(df.select("key", "us", "ord", (F.col("op") != "probe").alias("harvests"), F.when(F.col("op") == "set", F.col("value")).alias("f")), ["f"], 60)
    assert {r.ord: (r.live_before, r.before_f, r.after_f) for r in tracks.collect()} == after


def test_stages(spark):
    want = [stages.Stage("a", 2, 60), stages.Stage("b", 1, 60, skip=1)]
    run = lambda rows: [r.ord for r in stages.staged_sequence(spark.createDataFrame([("k", t * SECOND, o, s) for o, (t, s) in enumerate(rows)], "key string, us long, ord long, stage string"), want).collect()]
    assert run([(0, "a"), (1, "a"), (2, "b")]) == [2]
    assert run([(0, "a"), (60, "a"), (61, "b")]) == []  # the second is too late and begins anew
    assert run([(0, "a"), (1, "a"), (2, "x"), (3, "b")]) == [3]
    assert run([(0, "a"), (1, "a"), (2, "x"), (3, "x"), (4, "b")]) == []
    assert run([(0, "b"), (1, "a"), (2, "a"), (3, "a"), (4, "b")]) == [4]  # extra first hits do not restart


def test_deferred_takes_the_first_later_capture(spark):
    o = spark.createDataFrame([(1, "k", 0, 0), (2, "k", 5 * SECOND, 1), (3, None, 0, 9)], "id long, key string, us long, ord long")
    c = spark.createDataFrame([("k", 9 * SECOND, 2, "x"), ("k", 20 * SECOND, 3, "y")], "key string, us long, ord long, src string")
    got = state.correlate_deferred(o, c, ["src"], 9).select("id", "src").collect()
    assert [tuple(r) for r in got] == [(2, "x")]  # strictly less than nine seconds
    ctx = {r.id: (r.resolved, r.src) for r in state.correlate_context(o, c, ["src"], 60).collect()}
    assert ctx == {1: (False, None), 2: (False, None), 3: (True, None)}


def test_multiline(spark):
    rows = [("s", k, k * SECOND, line) for k, line in enumerate(["head", " a", " b", " c", "next", " d"])] + [("s", 6, 99 * SECOND, " late")]
    got = match.join_multiline(spark.createDataFrame(rows, "source string, seq long, us long, line string"), r"^\s", max_lines=3).orderBy("seq").collect()
    assert [r.line for r in got] == ["head\n a\n b", " c", "next\n d", " late"]


# --- sources and reports


def test_ledger_round_trip(spark, tmp_path):
    rows = [(100, "k", "1.2.3.4", 'r"q,\n', "w"), (10**9, "k", "5.6.7.8", "r", None)]
    logs.append_ledger(spark.createDataFrame(rows, logs.LEDGER), str(tmp_path / "l"))
    (tmp_path / "l" / "old.csv").write_text("epoch,kur,ip\n200,k,9.9.9.9\nmangled\n")
    got = sorted(map(tuple, logs.read_ledger(spark, str(tmp_path / "l")).collect()))
    assert got == [(100, "k", "1.2.3.4", 'r"q,', "w"), (200, "k", "9.9.9.9", None, None), (10**9, "k", "5.6.7.8", "r", None)]
    logs.compact_ledger(spark, str(tmp_path / "l"), str(tmp_path / "c"), 10**9, keep=5, recidive_find_time=6)
    assert [r.ip for r in logs.read_ledger(spark, str(tmp_path / "c")).collect()] == ["5.6.7.8"]
    assert sorted(r.ip for r in logs.read_ledger(spark, str(tmp_path / "l"), since=150).collect()) == ["5.6.7.8", "9.9.9.9"]
    assert reports.span_seconds("7d") == 604_800


def test_events_keep_both_ends(spark, tmp_path):
    ev = spark.createDataFrame([("found", "1.2.3.4", None, None), ("banish", None, None, 5)], "event_type string, src_ip string, dest_ip string, score int")
    logs.write_events(ev, str(tmp_path / "e"))
    text = sorted(r.value for r in spark.read.text(str(tmp_path / "e")).collect())
    assert text == ['{"event_type":"banish","score":5,"src_ip":null,"dest_ip":null}', '{"event_type":"found","src_ip":"1.2.3.4","dest_ip":null}']
    assert logs.read_events(spark, str(tmp_path / "e"), "event_type string, score int").where("score = 5").count() == 1


def test_blocklist_and_lines(spark, tmp_path):
    (tmp_path / "f").write_text("# head\n 10.0.0.0/8 # note\n\n10.0.0.0/8\n")
    assert [r.entry for r in logs.read_blocklist(spark, str(tmp_path / "f")).collect()] == ["10.0.0.0/8"]
    (tmp_path / "j").write_text('{"a": 1}\nbroken\n[1]\n')
    rows = logs.read_ndjson_logs(spark, str(tmp_path / "j")).collect()
    assert [r.fields for r in rows] == [{"a": "1"}, None, None]
    assert logs.read_journal_export(spark, str(tmp_path / "j")).where("record is null").count() == 3


def test_state_round_trip(spark, tmp_path):
    hits = spark.createDataFrame([("b", "k", 10 * SECOND, 1, None, "v"), ("b", "idle", 0, 2, 3, None)], "bucket string, key string, us long, ord long, w long, of string")
    marks = spark.createDataFrame([("m", "k", "v", 10**12, 5), ("m", "gone", "v", 1, 1)], "name string, key string, value string, expires long, first_set long")
    tracks = spark.createDataFrame([("t", "k", 10**12, {"a": "1"}), ("t", "gone", 1, {})], "name string, key string, expires long, fields map<string,string>")
    deposits = spark.createDataFrame([("b", "10.1.1.0/24", 10 * SECOND, 1, 2, "10.1.1.1"), ("b", "10.1.2.0/24", 0, 2, 2, "10.1.2.1")], "bucket string, key string, us long, ord long, w long, member string")
    logs.snapshot_state(str(tmp_path / "s"), hits, marks, tracks, deposits)
    seed = logs.seed_state(spark, str(tmp_path / "s"), 15 * SECOND, idle=10)
    assert [(r.key, r.w, r.of) for r in seed.hits.collect()] == [("k", 1, "v")]
    assert [r.key for r in seed.marks.collect()] == ["k"]
    assert [(r.key, r.fields) for r in seed.tracks.collect()] == [("k", {"a": "1"})]
    assert [(r.key, r.member) for r in seed.deposits.collect()] == [("10.1.1.0/24", "10.1.1.1")]
    logs.snapshot_state(str(tmp_path / "t"), hits, marks)
    assert logs.seed_state(spark, str(tmp_path / "t"), 15 * SECOND).tracks.count() == 0


def test_scenes_have_their_own_clock_and_marks(spark):
    rules = [
        match.Rule("probe", [r"probe from %%%%SRC%%%%$"], marks=[match.Mark("seen", ttl=60)]),
        match.Rule("worked", [r"login of (?<USER>\S+) from %%%%SRC%%%%$"]),
        match.Rule("foreign", [r"visit from %%%%SRC%%%%$"]),
    ]
    line = lambda m, advance=0: (m, "d", advance)
    scenes = [
        (1, "worked", [line("probe from 1.2.3.4"), line("login of bob from 1.2.3.4", 59)], 1, {"USER": "bob"}),
        (2, "worked", [line("probe from 1.2.3.4"), line("login of bob from 1.2.3.4", 60)], 0, {}),  # the mark has expired
        (3, "worked", [line("login of bob from 1.2.3.4"), line("probe from 1.2.3.4", 1)], 0, {}),  # marked too late
        (4, "worked", [line("login of bob from 1.2.3.4", 10)], 1, {}),  # marked before
        (5, "worked", [line("login of bob from 9.9.9.9", 10)], 0, {}),  # another address is
        (6, "worked", [line("login of bob from 1.2.3.4", 2)], 1, {}),  # a wrong label: no mark in this scene
        (7, "foreign", [line("visit from 10.1.2.3"), line("visit from 8.8.8.8")], 1, {}),
        (8, "probe", [line("probe from 1.2.3.4"), line("probe from 1.2.3.4", 5), line("noise")], 2, {"SRC": "1.2.3.4"}),
    ]
    cases = spark.createDataFrame(scenes, "case_id long, rule string, lines array<struct<message:string,daemon:string,advance:int>>, found int, data map<string,string>").withColumn("undefed", F.array(F.lit("DEST")))
    before = spark.createDataFrame([(4, "seen", "1.2.3.4", None, 60), (5, "seen", "1.2.3.4", None, 60)], "case_id long, name string, key string, value string, ttl int")
    ranges = spark.createDataFrame([(8 << 24, (9 << 24) - 1, "US"), (10 << 24, (11 << 24) - 1, "DE")], "first long, last long, code string")
    gate = {"foreign": lambda rows: gates.country_gate(rows, ["ip"], ranges, ["DE"], negate=True)}
    got = match.evaluate_scenes(cases, rules, ["daemon"], {"worked": ["seen"]}, before, gate).collect()
    assert {r.rule: (r.cases, r.passed) for r in got} == {"worked": (6, 5), "foreign": (1, 1), "probe": (1, 1)}


def test_networks_of_both_families(spark):
    rows = [("b", ip, t * SECOND, t, 1, None, None) for t, ip in enumerate(["10.1.1.1", "10.1.1.1", "2001:db8::1", "10.1.1.9", "2001:db8::2", "x"])]
    got = score.subnet_crossings(spark.createDataFrame(rows, HITS), 24, 100, 2, prefix_v6=64).collect()
    assert sorted((r.cidr, r.ord, r.members) for r in got) == [("10.1.1.0/24", 1, ["10.1.1.1"]), ("2001:db8::/64", 4, ["2001:db8::1", "2001:db8::2"])]
    assert score.subnet_crossings(spark.createDataFrame(rows, HITS), 24, 100, 2).count() == 1


def test_rule_lists_are_rows(spark, sf):
    from tidewatch.plans.queries import QUERIES

    plan = QUERIES["dedupe_rules"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "min(struct" in plan
    groups = spark.createDataFrame([("g", ["b", "a", "b"])], "name string, rules array<string>")
    listed = spark.createDataFrame([("w", 30, "a"), ("w", 7, "c"), ("w", 9, "g"), ("v", 1, "g")], "watcher string, i long, name string")
    arrays = spark.createDataFrame([("w", ["c", "g", "a"]), ("v", ["g"])], "watcher string, names array<string>")
    want = [("v", "a", 2), ("v", "b", 1), ("w", "a", 3), ("w", "b", 2), ("w", "c", 1)]
    assert sorted(map(tuple, match.dedupe_listed(listed, groups).collect())) == want
    assert sorted(map(tuple, match.dedupe_rules(arrays, groups).collect())) == want
