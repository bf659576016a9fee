"""Replayed scenes whose rules read each other's marks, in chains and circles, and records of other lines."""

from pyspark.sql import functions as F

from tidewatch.functions.predicates import Predicate
from tidewatch.operators import match
from tidewatch.operators.match import Mark, Rule, Track, Tracked

LINES = "case_id long, rule string, lines array<struct<message:string,daemon:string,advance:int>>, found int, data map<string,string>"


def cases(spark, rows):
    made = [(k, rule, [(m, d, a) for m, d, a in lines], found, data) for k, (rule, lines, found, data) in enumerate(rows)]
    return spark.createDataFrame(made, LINES).withColumn("undefed", F.array(F.lit("NONE")))


def says(*texts, daemon="d"):
    return [(t, daemon, a) for t, a in ((x if isinstance(x, tuple) else (x, 0)) for x in texts)]


def test_chains_of_readers(spark):
    step = lambda verb, mark: Rule(verb, [rf"{verb} from %%%%SRC%%%%$"], marks=[Mark(mark, ttl=60)])
    rules = [
        step("probe", "seen"), step("knock", "knocked"), step("login", "inside"), Rule("touch", [r"touch from %%%%SRC%%%%$"]),
        Rule("bye", [r"bye from %%%%SRC%%%%$"], marks=[Mark("inside", lift=True)]), Rule("odd", [r"odd from %%%%SRC%%%%$"]),
        Rule("ping", [r"p[io]ng from %%%%SRC%%%%$"], marks=[Mark("ping", ttl=60)]), Rule("pong", [r"pong from %%%%SRC%%%%$"], marks=[Mark("pong", ttl=60)]),
    ]
    a = "from 1.2.3.4"
    chain = [f"probe {a}", f"knock {a}", f"login {a}", f"touch {a}"]
    rows = [
        ("touch", says(*chain), 1, {"SRC": "1.2.3.4"}),
        ("touch", says(*chain[1:]), 0, {}),  # the first link is missing
        ("touch", says(chain[0], chain[2], chain[1], chain[3]), 0, {}),  # out of order
        ("touch", says(*chain[:3], (chain[3], 60)), 0, {}),  # the last mark has expired
        ("touch", says(chain[0], (chain[1], 59), (chain[2], 59), (chain[3], 59)), 1, {}),  # each link lives on its own
        ("touch", says(*chain[:3], f"bye {a}", chain[3]), 0, {}),  # lifted
        ("touch", says(*chain[:3], "touch from 9.9.9.9"), 0, {}),
        ("odd", says(f"odd {a}"), 1, {}),  # not marked
        ("odd", says(*chain[:3], f"odd {a}"), 0, {}),
        ("odd", says(*chain[:3], (f"odd {a}", 60)), 1, {}),
        ("ping", says(f"ping {a}", f"pong {a}"), 0, {}),  # a circle that nothing begins
        ("pong", says(f"ping {a}", f"pong {a}", f"pong {a}"), 2, {}),
    ]
    before = spark.createDataFrame([(11, "pong", "1.2.3.4", None, 60)], "case_id long, name string, key string, value string, ttl int")
    reads = {"knock": ["seen"], "login": ["knocked"], "touch": ["inside", "never"], "ping": ["pong"], "pong": ["ping"]}
    got = match.evaluate_scenes(cases(spark, rows), rules, ["daemon"], reads, before, not_marked_by={"odd": ["inside"]}).collect()
    assert {r.rule: (r.cases, r.passed) for r in got} == {"touch": (7, 7), "odd": (3, 3), "ping": (1, 1), "pong": (1, 1)}
    none = match.evaluate_scenes(cases(spark, []), rules, ["daemon"], reads, before).collect()
    assert none == []


def test_records_of_other_lines(spark):
    queue = lambda *fields: Track("queue", ["ID"], list(fields), ttl=60)
    has_client = [Predicate("CLIENT", "exists"), Predicate("CLIENT", "cidr", ["10.0.0.0/8"], negate=True)]
    rules = [
        Rule("arrive", [r"^(?<ID>\w+): client=(?<CLIENT>\S+)$"], ban_vars=[], only={"daemon": ["mx"]}, ignore=["test"], track=[queue("CLIENT")], mark_only=True),
        Rule("bounce", [r"^(?<ID>\w+): bounced$", "^NOQUEUE: bounced (?<CLIENT>.+)$"], ban_vars=["CLIENT"], track=[queue()], tracked=[Tracked("queue", has_client, ["CLIENT"])], marks=[Mark("bad")]),
        Rule("lift", [r"^(?<ID>\w+): lifted$"], ban_vars=["CLIENT"], track=[queue()], tracked=[Tracked("queue", into=["CLIENT"])]),
        Rule("fresh", [r"^(?<ID>\w+): fresh$"], ban_vars=[], track=[queue()], not_tracked=["queue"]),
        Rule("again", [r"again from %%%%SRC%%%%$"]),
    ]
    mx = lambda *texts: says(*texts, daemon="mx")
    q = "Q1: client=1.2.3.4"
    rows = [
        ("bounce", mx(q, "Q1: bounced"), 1, {"CLIENT": "1.2.3.4", "ID": "Q1"}),  # lifted from another line
        ("bounce", mx(q, "Q2: bounced"), 0, {}),
        ("bounce", mx("Q1: client=10.1.1.1", "Q1: bounced"), 0, {}),  # the record's own field is tested
        ("bounce", mx(q, ("Q1: bounced", 60)), 0, {}),  # it has expired
        ("bounce", mx(q, ("Q1: lifted", 59), ("Q1: bounced", 59)), 1, {}),  # a sight keeps it alive
        ("bounce", says(q, "Q1: bounced"), 0, {}),  # not the daemon that adds
        ("bounce", mx("Q1: client=test", "Q1: bounced"), 0, {}),  # ignored lines add nothing
        ("bounce", mx("NOQUEUE: bounced 5.5.5.5"), 1, {"CLIENT": "5.5.5.5"}),  # no key, no veto
        ("bounce", mx("Q7: bounced"), 1, {"CLIENT": "7.7.7.7"}),  # a record from before
        ("bounce", mx(("Q7: bounced", 5)), 0, {}),  # which lasts five seconds
        ("lift", mx("Q1: lifted"), 1, {"ID": "Q1"}),  # nothing to lift is no veto
        ("fresh", mx("Q1: fresh", "Q1: fresh", ("Q1: fresh", 60)), 2, {}),
        ("again", mx(q, "Q1: bounced", "again from 1.2.3.4"), 1, {}),  # the mark stands on the lifted offender
        ("again", mx(q, "Q2: bounced", "again from 1.2.3.4"), 0, {}),
    ]
    before = spark.createDataFrame([(k, "queue", "Q7", {"CLIENT": "7.7.7.7"}, 5) for k in (8, 9)], "case_id long, name string, key string, fields map<string,string>, ttl int")
    got = match.evaluate_scenes(cases(spark, rows), rules, ["daemon"], {"again": ["bad"]}, tracks_before=before).collect()
    assert {r.rule: (r.cases, r.passed) for r in got} == {"bounce": (10, 10), "lift": (1, 1), "fresh": (1, 1), "again": (2, 2)}
