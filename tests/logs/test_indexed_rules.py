"""Rules as a table give the hits of rules as expressions, and the plan does not grow with them."""

import random

from pyspark.sql import functions as F

from tidewatch.functions.predicates import Predicate
from tidewatch.operators import indexed, match
from tidewatch.operators.match import Rule

RULES = [
    Rule("a", [r"fail (?<N>\d+) from %%%%SRC%%%%$", r"from %%%%SRC%%%%$"], only={"daemon": ["ssh", "ftp"]}, weight=3),
    Rule("b", [r"fail (?<N>\d+)", r"(?<N>\w+) from %%%%SRC%%%%"], only={"daemon": ["ssh"], "host": ["h1"]}, ignore=["veto", r"fail 3\d"], mark_only=True),
    Rule("c", [r"(?:as (?<host>\S+)|to (?<host>\S+))$", "plain"], detection_vars=["host", "daemon"]),
    Rule("d", [r"fail (?<N>\d*) from", "from %%%%SRC%%%%"], only={"daemon": ["ssh", "web"]}, tests=[Predicate("N", "exists"), Predicate("N", "gt", [20])]),
    Rule("e", only={"daemon": ["bare"]}), Rule("f", ["plain"], only={"daemon": []}), Rule("g", ["x.y"], only={"host": ["h2"]}),
]


def hits_of(df):
    # a rule that matches by no pattern, or each line's hits with their maps as lists
    rows = df.where(F.size("hits") > 0).select("id", "hits").collect()
    return {r.id: [(h.rule_int, h.rule, h.pattern, dict(h["data"]), h.offenders, h.subjects, h.consumes, h.w) for h in r.hits] for r in rows}


def lines(spark, n=3000):
    rnd = random.Random(5)
    ends = ["from 1.2.3.4", "from 2001:db8::1", "from nowhere", "as root", "to h9", "plain", "x\ny", "x\ry", "", "veto", "from 1.2.3.4\x1f", "fail\x1e from 1.2.3.4"]
    rows = [(k, rnd.choice(["ssh", "ftp", "web", "bare", "other", None]), rnd.choice(["h1", "h2", None]), None if k % 50 == 0 else f"fail {rnd.choice([k % 40, 'x', ''])} {rnd.choice(ends)}") for k in range(n)]
    return spark.createDataFrame(rows, "id long, daemon string, host string, message string")


def test_the_table_matches_as_the_expressions_do(spark):
    rows = lines(spark)
    want = hits_of(match.match_rules(rows, RULES, "message", ["daemon", "host"]))
    got = indexed.match_rules_indexed(rows, RULES, "message", ["daemon", "host"], ["id"])
    assert got.columns == ["id", "daemon", "host", "message", "hits"]
    assert hits_of(got) == want
    assert {h[1] for hs in want.values() for h in hs} == set("abcdeg")
    for mode in ("first", "shadow"):
        judge = lambda df: hits_of(df.withColumn("hits", match.overlap(F.col("hits"), mode)))  # noqa: E731, B023
        assert judge(got) == judge(match.match_rules(rows, RULES, "message", ["daemon", "host"]))
    assert hits_of(indexed.match_rules_indexed(rows.limit(0), RULES, "message", ["daemon", "host"], ["id"])) == {}


def test_rules_without_a_field_in_common(spark):
    rows = lines(spark, 300)
    some = [RULES[2]]
    assert indexed.index_field(some) is None and indexed.index_field(RULES) == "daemon"
    assert hits_of(indexed.match_rules_indexed(rows, some, "message", ["host"], ["id"])) == hits_of(match.match_rules(rows, some, "message", ["host"]))


def test_the_plan_does_not_grow_with_the_rules(spark):
    rows = lines(spark, 10)
    made = lambda n: [Rule(f"r{k}", [rf"fail{k} from %%%%SRC%%%%$"], only={"daemon": [f"d{k}"]}) for k in range(n)]
    sizes = [len(indexed.match_rules_indexed(rows, made(n), "message", ["daemon"], ["id"])._jdf.queryExecution().optimizedPlan().toString()) for n in (2, 200)]
    assert sizes[1] < sizes[0] + 200
