"""Scenes that many cases share are replayed once, and lines that are nothing to a rule leave no row."""

from itertools import accumulate

from pyspark.sql import functions as F

from tidewatch.operators import match
from tidewatch.operators.match import Mark, Rule, Track, Tracked

LINES = "case_id long, rule string, lines array<struct<message:string,daemon:string,advance:int>>, found int, data map<string,string>"
RULES = [
    Rule("probe", [r"probe from %%%%SRC%%%%$"], marks=[Mark("seen", ttl=60)]),
    Rule("login", [r"login (?<ID>\S+) from %%%%SRC%%%%$"], track=[Track("session", ["ID"], ["SRC"], 60)]),
    Rule("steal", [r"steal (?<ID>\S+)$"], track=[Track("session", ["ID"], [], 60)], tracked=[Tracked("session", into=["SRC"])]),
]


def cases(spark, rows):
    made = [(k, rule, [(m, "d", a) for m, a in lines], found, {}) for k, (rule, lines, found) in enumerate(rows)]
    return spark.createDataFrame(made, LINES).withColumn("undefed", F.array(F.lit("NONE")))


def test_alike_cases_are_one_scene(spark, monkeypatch):
    wrote, plain = {}, match.written

    def counted(df, label, by=None):
        out = plain(df, label, by)
        wrote[label] = wrote.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(match, "written", counted)
    a = "from 10.0.0.1"
    lines = [("noise", 0), (f"probe {a}", 0), ("more noise", 30), (f"login s1 {a}", 29), ("steal s1", 59)]
    late = [*lines[:4], ("steal s1", 61)]  # the same texts, another clock: a scene of its own
    rows = [("login", lines, 1), ("steal", lines, 1), ("login", lines, 0), ("steal", lines, 1)] * 5 + [("steal", late, 0), ("probe", late, 1)]
    got = match.evaluate_scenes(cases(spark, rows), RULES, ["daemon"], {"login": ["seen"]}).collect()
    assert {r.rule: (r.cases, r.passed) for r in got} == {"login": (10, 5), "steal": (11, 10), "probe": (1, 1)}
    assert wrote.pop("cases", 0) <= len(rows)
    # two scenes of five lines, each with a probe, a login and a theft; 22 cases of 5 lines and 3 rules before
    assert sum(wrote.values()) <= 2 + 2 * 3 + 2 * 2, wrote


def test_cases_with_marks_of_their_own_stay_apart(spark):
    lines = [("login s1 from 10.0.0.1", 0)]
    before = spark.createDataFrame([(1, "seen", "10.0.0.1", None, 60)], "case_id long, name string, key string, value string, ttl int")
    rows = [("login", lines, 0), ("login", lines, 1)]
    got = match.evaluate_scenes(cases(spark, rows), RULES, ["daemon"], {"login": ["seen"]}, before).collect()
    assert [(r.rule, r.cases, r.passed) for r in got] == [("login", 2, 2)]


def test_clock_of_long_scenes(spark):
    for advance in ([], [7], [5, None, 3], list(range(1, 1001)), [None] * 4 + [2**31 - 1] * 5):
        df = spark.createDataFrame([([("x", "d", a) for a in advance],)], "lines array<struct<message:string,daemon:string,advance:int>>")
        got = df.select(match._clocked(F.col("lines"), ["daemon"])["us"].alias("us")).head().us
        assert got == [(match.CLOCK_BASE + s) * 1_000_000 for s in accumulate(a or 0 for a in advance)]
