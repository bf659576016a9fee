"""Rules on lines: one pass gives an array of hits per line, hits become offender rows, overlap decides between rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import let
from ..functions.predicates import Predicate, all_of, any_of, capture_names, first_match, gate, ignored, sure
from ..sources.scratch import written
from .common import SECOND, ordered_fold, with_value
from .state import compound_key, tracks


@dataclass
class Mark:
    """A brand that a fired match sets, or lifts: on the field ``vars[0]``, on a compound of several, or without any on
    each offender that survived. ``value_var`` names the field whose value the mark carries."""

    name: str
    vars: list[str] = field(default_factory=list)
    value_var: str | None = None
    ttl: int = 3600
    lift: bool = False


@dataclass
class Track:
    """A record that a rule is party to, under its field or fields ``key``: each line that passes the rule's ``only`` and
    ``ignore`` adds those of ``fields`` that it has, whether or not it matches, and keeps the record alive."""

    name: str
    key: list[str]
    fields: list[str] = field(default_factory=list)
    ttl: int = 3600


@dataclass
class Tracked:
    """What a rule asks of a record as it was before the line: ``where`` must hold, fields ``into`` are lifted into the match.
    A line without the key passes; one whose record isn't live passes only without ``where``."""

    name: str
    where: list[Predicate] = field(default_factory=list)
    into: list[str] = field(default_factory=list)


@dataclass
class Rule:
    """A signature. Its place in the list of a watcher is its number.

    ``only``: field -> values that the record must have one of (daemons, methods, status codes...); ``ignore``: patterns
    that veto the line; ``patterns``: ordered, the first match gives the captures; ``tests``: all must hold.
    """

    name: str
    patterns: list[str] = field(default_factory=list)
    ban_vars: list[str] = field(default_factory=lambda: ["SRC"])
    detection_vars: list[str] = field(default_factory=list)
    only: dict[str, list[str]] = field(default_factory=dict)
    ignore: list[str] = field(default_factory=list)
    tests: list[Predicate] = field(default_factory=list)
    mark_only: bool = False
    weight: int = 1
    marks: list[Mark] = field(default_factory=list)
    track: list[Track] = field(default_factory=list)
    tracked: list[Tracked] = field(default_factory=list)
    not_tracked: list[str] = field(default_factory=list)


def match_type_gate(only: dict[str, list[str]], of: dict[str, Column]) -> Column:
    return all_of([sure(of[f].isin(values)) for f, values in only.items()])


def rule_hit(rule: Rule, number: int, message: Column, of: dict[str, Column]) -> Column:
    """struct(rule_int, rule, pattern, data) where the rule matches the line, else null."""
    passes = match_type_gate(rule.only, of) & ~ignored(message, rule.ignore)
    names = capture_names(rule.patterns)

    def hit(found: Column) -> Column:
        fields = of | {n: found[n] for n in names}
        data = F.create_map(*(x for n, c in fields.items() for x in (F.lit(n), c.cast("string")))) if fields else F.create_map().cast("map<string,string>")
        listed = lambda vs: F.array(*(fields.get(v, F.lit(None).cast("string")) for v in vs)).cast("array<string>")
        made = F.struct(
            F.lit(number).alias("rule_int"), F.lit(rule.name).alias("rule"), found["pattern"].alias("pattern"), F.map_filter(data, lambda k, v: v.isNotNull()).alias("data"),
            listed(rule.ban_vars).alias("offenders"), listed(rule.detection_vars).alias("subjects"), F.lit(not rule.mark_only).alias("consumes"), F.lit(rule.weight).alias("w"),
        )
        return F.when(found.isNotNull() & gate(rule.tests, fields), made)

    match = first_match(message, rule.patterns) if rule.patterns else F.struct(F.lit(0).alias("pattern"))
    return let(F.when(passes, match), hit)


def match_rules(lines: DataFrame, rules: list[Rule], message: str, fields: list[str], of_rule: Callable[[Rule, int, Column, dict[str, Column]], Column] | None = None) -> DataFrame:
    """Add ``hits``: the array of rules that match each line, in the order of the list. Rules never multiply lines.

    ``of_rule``: what a rule makes of a line in place of ``rule_hit``, null for nothing. What rules ask of records
    (``tracked``) is not judged here, for it hangs on other lines."""
    made = of_rule or rule_hit
    record = F.struct(F.col(message).alias("message"), *(F.col(f).cast("string").alias(f"f_{f}") for f in fields))

    def hits(r: Column) -> Column:
        of = {f: r[f"f_{f}"] for f in fields}
        return F.array_compact(F.array(*(made(rule, k, r["message"], of) for k, rule in enumerate(rules))))

    return lines.withColumn("hits", let(record, hits))


def overlap(hits: Column, mode: str) -> Column:
    """Which hits of a line judge. 'first': those up to the first that consumes it; 'shadow': all, later ones demoted;
    'all': all. Adds ``demoted`` to each hit."""
    if mode not in ("first", "shadow", "all"):
        raise ValueError(mode)

    def judged(hits: Column) -> Column:
        with_flag = lambda flag: F.transform(hits, lambda h: h.withField("demoted", flag(h)))
        if mode == "all":
            return with_flag(lambda h: F.lit(False))
        consumers = F.transform(F.filter(hits, lambda h: h["consumes"]), lambda h: h["rule_int"])

        def split(first: Column) -> Column:
            if mode == "first":
                return F.filter(with_flag(lambda h: F.lit(False)), lambda h: F.coalesce(h["rule_int"] <= first, F.lit(True)))
            return with_flag(lambda h: h["consumes"] & F.coalesce(h["rule_int"] > first, F.lit(False)))

        return let(F.array_min(consumers), split)

    return let(hits, judged)


def parsed_lines(lines: DataFrame, parser: Callable[[Column], Column], line: str = "line", out: str = "record") -> DataFrame:
    """Lines that fit the parser, with its record."""
    return with_value(lines, parser(F.col(line)), out)


def explode_hits(lines: DataFrame) -> DataFrame:
    """One row for each hit of each line."""
    # an expression, not the column itself: no filter on its size is inferred that would match each line once more
    return lines.withColumn("hit", F.explode(F.array_compact("hits"))).drop("hits").select("*", "hit.*").drop("hit")


def explode_offenders(matches: DataFrame) -> DataFrame:
    """One row for each offender that is there, with its place ``pos`` among the rule's variables."""
    return matches.select("*", F.posexplode("offenders").alias("pos", "ip")).drop("offenders", "subjects").where("ip is not null")


def explode_subjects(matches: DataFrame) -> DataFrame:
    """One row for each subject of a detection rule that is there and not empty."""
    return matches.select("*", F.posexplode("subjects").alias("pos", "subject")).drop("offenders", "subjects").where("subject is not null and subject <> ''")


def fired(matches: DataFrame, survivors: DataFrame, ids: list[str]) -> DataFrame:
    """Add ``fired`` and ``ip`` (the first survivor). A match whose offenders were all vetoed has not fired; one that
    never had any fires."""
    left = survivors.groupBy(*ids).agg(F.min_by("ip", "pos").alias("ip"))
    had = F.exists("offenders", lambda x: x.isNotNull())
    return matches.join(left, ids, "left").withColumn("fired", ~had | F.col("ip").isNotNull())


def apply_marks(matches: DataFrame, survivors: DataFrame, rules: list[Rule], ids: list[str], scope: str | None = None) -> DataFrame:
    """Mark events (name, key, us, ord, op, value, ttl) of fired matches, for the operators on marks; with ``scope`` also
    that column of the match.

    ``matches``: fired ones (ids, rule_int, data, us, ord); ``survivors``: their offenders that may be branded (ids, pos, ip).
    ``ord`` becomes a struct of the line's order, the rule's place, and the mark's place in the rule (those that lift
    after those that set): a rule sees the marks of rules before it in the list. A field that is absent, or a compound
    with a part that is absent or empty, marks nothing.
    """
    order = lambda k: F.struct("ord", F.col("rule_int").cast("int").alias("rule_int"), F.lit(k).alias("place"))
    value_of = lambda n: F.try_element_at("data", F.lit(n)) if n is not None else F.lit(None).cast("string")

    def event(rule: int, k: int, mark: Mark, key: Column) -> Column:
        one = F.struct(
            F.lit(mark.name).alias("name"), key.alias("key"), order(k).alias("ord"), F.lit("unset" if mark.lift else "set").alias("op"),
            F.when(F.lit(not mark.lift), value_of(mark.value_var)).alias("value"), F.lit(None if mark.lift else mark.ttl).cast("long").alias("ttl"),
        )
        return F.when((F.col("rule_int") == rule) & key.isNotNull(), one)

    listed = [(r, k, m) for r, rule in enumerate(rules) for k, m in enumerate(sorted(rule.marks, key=lambda m: m.lift))]
    keys = lambda m: value_of(m.vars[0]) if len(m.vars) == 1 else compound_key([value_of(v) for v in m.vars])
    by_field = [event(r, k, m, keys(m)) for r, k, m in listed if m.vars]
    by_offender = [event(r, k, m, F.col("ip")) for r, k, m in listed if not m.vars]
    more = [F.col(scope).alias("scope")] if scope is not None else []
    parts = [matches.select("us", *more, F.explode(F.array_compact(F.array(*by_field))).alias("m"))] if by_field else []
    if by_offender:
        branded = survivors.select(*ids, "ip").join(matches, ids)
        parts.append(branded.select("us", *more, F.explode(F.array_compact(F.array(*by_offender))).alias("m")))
    if not parts:
        raise ValueError("no rule sets or lifts a mark")
    return reduce(DataFrame.unionByName, parts).select("m.name", "m.key", "us", "m.ord", "m.op", "m.value", "m.ttl", *(["scope"] if more else []))


def union_watchers(watchers: dict[str, DataFrame]) -> DataFrame:
    """Matches of all watchers of a kur, with their names, for one bucket."""
    named = [df.withColumn("watcher", F.lit(n)) for n, df in watchers.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def dedupe_rules(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """(watcher, rule, place): groups in a watcher's list replaced by their rules, each rule at its first place.

    ``rules``: (watcher, names array); ``groups``: (name, rules array)."""
    return dedupe_listed(rules.select("watcher", F.posexplode("names").alias("i", "name")), groups)


def dedupe_listed(named: DataFrame, groups: DataFrame) -> DataFrame:
    """``dedupe_rules`` of lists that are rows (watcher, i, name), ``i`` in the list's order: no list is one array."""
    each = named.join(groups.withColumnRenamed("name", "_g"), F.col("name") == F.col("_g"), "left").select("watcher", "i", F.posexplode(F.coalesce("rules", F.array("name"))).alias("j", "rule"))
    first = each.groupBy("watcher", "rule").agg(F.min(F.struct("i", "j")).alias("at"))
    return first.select("watcher", "rule", F.row_number().over(Window.partitionBy("watcher").orderBy("at")).alias("place"))


def join_multiline(lines: DataFrame, continuation: str, max_lines: int = 50, flush_after: int = 2, block: Column | None = None) -> DataFrame:
    """Glue continuation lines to their heads: (source, seq, us, line, n_lines), ``seq`` and ``us`` of the head.

    A head, max_lines, or a gap of flush_after seconds ends a record; the rest of a long one is a record of its own. Lines
    without a time ``us`` (or a table without that column) have no gaps; a null line continues nothing.

    ``block``: a part of the source that grows with ``seq``, as ``seq.block`` of ``read_logs``. Each block is then a task of
    its own, and a block hands on one row, however long a source or a record is; without it a source is one task.
    """
    us = F.col("us") if "us" in lines.columns else F.lit(None).cast("long")
    rows = lines.select("source", "seq", us.alias("us"), "line", (F.lit(0) if block is None else block).alias("_block"))
    late = lambda before: sure(F.col("us") - before >= flush_after * 1_000_000)
    order = Window.partitionBy("source", "_block").orderBy("seq")
    rows = rows.withColumns({"_n": F.row_number().over(order), "_before": F.lag("us").over(order)})
    rows = rows.withColumn("_head", ~sure(F.col("line").rlike(continuation)) | late(F.col("_before")))
    if block is None:
        rows = rows.withColumn("_head", F.col("_head") | (F.col("_n") == 1))
    else:
        rows = rows.join(_open_records(rows, late), ["source", "_block"])
        rows = rows.withColumn("_head", F.col("_head") | ((F.col("_n") == 1) & (F.col("_first") | late(F.col("_end_us")))))
    # a record's name: where its head stands, here or in an earlier block
    at = F.when(F.col("_head"), F.struct("_block", F.col("_n").cast("long").alias("n")))
    rows = rows.withColumn("_here", F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if block is None:
        rows = rows.withColumns({"_record": F.col("_here"), "_place": F.col("_n") - F.col("_here.n")})
    else:
        carried = F.col("_carried") + F.col("_n") - 1
        rows = rows.withColumns({"_record": F.coalesce("_here", "_open"), "_place": F.when(F.col("_here").isNull(), carried).otherwise(F.col("_n") - F.col("_here.n"))})
    rows = rows.withColumn("_chunk", F.floor(F.col("_place") / max_lines))
    glued = rows.groupBy("source", "_record", "_chunk").agg(F.sort_array(F.collect_list(F.struct("seq", "us", "line"))).alias("x"))  # max_lines at most
    return glued.select("source", F.col("x")[0]["seq"].alias("seq"), F.col("x")[0]["us"].alias("us"), F.array_join(F.col("x.line"), "\n").alias("line"), F.size("x").alias("n_lines"))


def _open_records(rows: DataFrame, late: Callable[[Column], Column]) -> DataFrame:
    """What each block of a source begins with: ``_first`` (nothing is before it), ``_end_us`` of the line before, the record
    ``_open`` that is not ended there and the number of its lines so far, ``_carried``. One row for each block goes through the window."""
    one = rows.groupBy("source", "_block").agg(
        F.count("*").alias("_rows"), F.min_by("us", "seq").alias("us"), F.max_by(F.struct("us"), "seq")["us"].alias("_last_us"),
        F.max(F.when(F.col("_head"), F.col("_n"))).cast("long").alias("_head_n"),
    )
    order = Window.partitionBy("source").orderBy("_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumns({"_first": F.row_number().over(order) == 1, "_end_us": F.lag("_last_us").over(order), "_sofar": F.coalesce(F.sum("_rows").over(before), F.lit(0))})
    # a block without a head of its own goes on with the record before, unless its first line comes late
    head_n = F.coalesce("_head_n", F.when(F.col("_first") | late(F.col("_end_us")), F.lit(1).cast("long")))
    last = F.when(head_n.isNotNull(), F.struct(F.struct("_block", head_n.alias("n")).alias("open"), (F.col("_sofar") + head_n - 1).alias("begin")))
    one = one.withColumn("_last", last).withColumn("_last", F.last("_last", ignorenulls=True).over(before))
    return one.select("source", "_block", "_first", "_end_us", F.col("_last.open").alias("_open"), (F.col("_sofar") - F.col("_last.begin")).alias("_carried"))


def evaluate_rules(cases: DataFrame, rules: list[Rule], fields: list[str]) -> DataFrame:
    """Replay labelled lines: ``cases`` (case_id, rule, message, fields..., found int, data map, undefed array) ->
    (rule, cases, passed). A case passes if the rule's hits are as many as expected, and captures as labelled."""
    got = match_rules(cases, rules, "message", fields)
    mine = F.filter("hits", lambda h: h["rule"] == F.col("rule"))
    return _judged(got.withColumns({"_n": F.size(mine), "_data": F.try_element_at(mine, F.lit(1))["data"]}))


def _judged(got: DataFrame) -> DataFrame:
    """(rule, cases, passed) of cases with their number of hits ``_n`` and the captures ``_data`` of the first."""
    data = F.col("_data")
    right = F.forall(F.map_entries(F.col("data")), lambda e: F.coalesce(F.try_element_at(data, e["key"]) == e["value"], F.lit(False)))
    absent = ~any_of([F.exists("undefed", lambda n: F.coalesce(F.array_contains(F.map_keys(data), n), F.lit(False)))])
    ok = (F.col("_n") == F.col("found")) & ((F.col("found") == 0) | (F.coalesce(right, F.lit(True)) & F.coalesce(absent, F.lit(True))))
    return got.groupBy("rule").agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"))


#: When the virtual clock of replayed cases begins, in epoch seconds.
CLOCK_BASE = 1_000_000_000


def evaluate_scenes(
    cases: DataFrame, rules: list[Rule], fields: list[str], marked_by: dict[str, list[str]] | None = None, marks_before: DataFrame | None = None,
    gates: dict[str, Callable[[DataFrame], DataFrame]] | None = None, not_marked_by: dict[str, list[str]] | None = None, tracks_before: DataFrame | None = None,
) -> DataFrame:
    """Replay labelled scenes of several lines: ``cases`` (case_id, rule, lines array<struct<message, fields..., advance>>,
    found int, data map, undefed array) -> (rule, cases, passed).

    A scene has a clock of its own, which begins at CLOCK_BASE and is ``advance`` seconds further at each line, and marks and
    records of its own: those of ``marks_before`` (case_id, name, key, value, ttl) and ``tracks_before`` (case_id, name, key,
    fields map, ttl), and those that its rules set on the way. ``marked_by``, ``not_marked_by``: rule -> names of which its
    offender must bear one, or none. ``gates``: rule -> a gate over its offenders (case_id, ip, data, ...), as those of
    addresses, names and places are; what a gate drops has not fired. A rule fires for a line once, however many of its
    offenders are left.

    Records come first, as windows: what they hold does not hang on what fires. Marks do, and rules may read each other's in
    chains and circles, so the matches of a scene are one fold in the order of lines and rules, many scenes at a time. Cases
    with the same lines are one scene, replayed once, unless something may tell them apart: a gate, or what was there before.
    """
    cases = cases.withColumn("_lines", _clocked(F.col("lines"), fields)).drop("lines")
    if gates or marks_before is not None or tracks_before is not None:
        cases = written(cases.withColumn("_scene", F.col("case_id")), "cases")
        scenes = cases.select("case_id", "_lines")
        cases = cases.drop("_lines")
    else:
        cases = written(cases.withColumn("_h", F.xxhash64("_lines")), "cases")  # compared before the lines are
        scenes = written(cases.select("_h", "_lines").distinct().withColumn("case_id", F.monotonically_increasing_id()), "scenes")
        cases = cases.join(scenes.withColumnRenamed("case_id", "_scene"), ["_h", "_lines"], "left").drop("_h", "_lines")
    rows = scenes.select("case_id", F.posexplode("_lines").alias("ord", "line")).select("case_id", "line.us", F.col("ord").cast("long").alias("ord"), "line.message", *(F.col(f"line.{f}") for f in fields))
    party = [k for k, rule in enumerate(rules) if rule.track]
    made = lambda rule, *more: _sight(rule, *more) if rule.track else rule_hit(rule, *more)
    kept = [*rows.columns, "rule_int", "rule", "pattern", "data", "offenders", "subjects"]
    found = written(explode_hits(match_rules(rows, rules, "message", fields, made)).select(kept), "matches")  # one pass over the patterns; read by every step below
    hits = found.where(~F.col("rule_int").isin(party)).drop("pattern") if party else found.drop("pattern")
    if party:
        hits = hits.unionByName(written(_tracked_hits(found.where(F.col("rule_int").isin(party)), rules, fields, tracks_before), "tracked"))
    ids = ["case_id", "ord", "rule_int"]
    firing = _firing(_with_survivors(hits, gates or {}, ids), rules, marked_by or {}, not_marked_by or {}, marks_before)
    counted = firing.groupBy("case_id", "rule_int").agg(F.count("*").cast("int").alias("_n"), F.min("ord").alias("ord"))
    counted = hits.select(*ids, "rule", F.col("data").alias("_data")).join(counted, ids).select(F.col("case_id").alias("_scene"), "rule", "_n", "_data")
    got = cases.join(counted, ["_scene", "rule"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return _judged(got)


def _clocked(lines: Column, fields: list[str]) -> Column:
    """The lines of a scene with the time ``us`` of each: sums of ``advance`` by doubling, so that a long scene is no more than
    n log n."""
    advance = F.transform(lines, lambda x: F.coalesce(x["advance"].cast("long"), F.lit(0).cast("long")))

    def doubled(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(F.lit(0).cast("long")))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lines), F.lit(1)))).cast("int"))
    at = lambda sums, i: (F.lit(CLOCK_BASE) + F.get(sums, i)) * SECOND
    line = lambda x, us: F.struct(x["message"].alias("message"), *(x[f].cast("string").alias(f) for f in fields), us.cast("long").alias("us"))
    return let(F.aggregate(rounds, advance, doubled), lambda sums: F.transform(lines, lambda x, i: line(x, at(sums, i))))


def _with_survivors(hits: DataFrame, gates: dict[str, Callable[[DataFrame], DataFrame]], ids: list[str]) -> DataFrame:
    """Add ``had`` (the match has offenders) and ``left``, those that the rule's gate lets through."""
    rows = hits.withColumns({"had": F.exists("offenders", lambda x: x.isNotNull()), "left": F.array_compact("offenders")})
    out = rows.where(~F.col("rule").isin(list(gates))) if gates else rows
    for rule, gate_of in gates.items():
        mine = rows.where(F.col("rule") == rule)
        through = gate_of(explode_offenders(mine.drop("had", "left"))).groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("pos", "ip")))["ip"].alias("left"))  # a rule's ban_vars at most
        out = out.unionByName(mine.drop("left").join(through, ids, "left").withColumn("left", F.coalesce("left", F.array().cast("array<string>"))))
    return out


def _firing(hits: DataFrame, rules: list[Rule], marked_by: dict[str, list[str]], not_marked_by: dict[str, list[str]], marks_before: DataFrame | None) -> DataFrame:
    """(case_id, ord, rule_int) of the matches that fire, given marks that earlier ones of the scene set and lifted."""
    field_of = lambda n: F.try_element_at("data", F.lit(n))
    marks = {k: sorted(r.marks, key=lambda m: m.lift) for k, r in enumerate(rules) if r.marks}
    key_of = lambda m: F.lit(None).cast("string") if not m.vars else field_of(m.vars[0]) if len(m.vars) == 1 else compound_key([field_of(v) for v in m.vars])
    keys = F.coalesce(*(F.when(F.col("rule_int") == k, F.array(*map(key_of, listed))) for k, listed in marks.items()), F.array().cast("array<string>"))
    rows = hits.select("case_id", "ord", F.col("rule_int").cast("int").alias("rule_int"), "us", "had", "left", keys.alias("keys"))
    if marks_before is not None:
        old = F.array("name", F.col("key").cast("string"), F.col("ttl").cast("long").cast("string"))
        first = {"ord": F.lit(-1).cast("long"), "rule_int": F.lit(-1), "us": F.lit(CLOCK_BASE * SECOND).cast("long"), "had": F.lit(False), "left": F.array().cast("array<string>"), "keys": old}
        rows = rows.unionByName(marks_before.where("name is not null and key is not null and ttl is not null").select(F.col("case_id").cast(dict(hits.dtypes)["case_id"]).alias("case_id"), *(c.alias(n) for n, c in first.items())))
    must = {k: marked_by[r.name] for k, r in enumerate(rules) if r.name in marked_by}
    must_not = {k: not_marked_by[r.name] for k, r in enumerate(rules) if r.name in not_marked_by}

    def step(live: dict, row: tuple) -> list[tuple]:
        case, place, rule, us, had, left, keys = row
        if rule < 0:  # from before the scene
            live[keys[0], keys[1]] = us + int(keys[2]) * SECOND
            return []
        bears = lambda ip, names: any(live.get((n, ip), us) > us for n in names)
        left = [ip for ip in left if (rule not in must or bears(ip, must[rule])) and not (rule in must_not and bears(ip, must_not[rule]))]
        if had and not left:
            return []
        for mark, mine in zip(marks.get(rule, ()), keys, strict=False):
            for key in ([mine] if mine is not None else []) if mark.vars else left:
                if mark.lift:
                    live.pop((mark.name, key), None)
                else:
                    live[mark.name, key] = us + mark.ttl * SECOND
        return [(case, place, rule)]

    return ordered_fold(rows, ["case_id"], ["ord", "rule_int"], dict, step, f"case_id {dict(hits.dtypes)['case_id']}, ord long, rule_int int")


def _sight(rule: Rule, number: int, message: Column, of: dict[str, Column]) -> Column:
    """What a rule that is party to records makes of a line: as ``rule_hit``, but ``pattern`` is null where none matches, and tests
    and offenders wait for the records. A line that neither matches nor has the key of a record is nothing to the rule."""
    names = capture_names(rule.patterns)

    def made(found: Column) -> Column:
        held = of | {n: found[n] for n in names}
        data = F.create_map(*(x for n, c in held.items() for x in (F.lit(n), c.cast("string")))) if held else F.create_map().cast("map<string,string>")
        part = any_of([compound_key([held.get(v, F.lit(None)).cast("string") for v in t.key]).isNotNull() for t in rule.track])
        none = F.lit(None).cast("array<string>")
        sight = F.struct(
            F.lit(number).alias("rule_int"), F.lit(rule.name).alias("rule"), found["pattern"].alias("pattern"), F.map_filter(data, lambda k, v: v.isNotNull()).alias("data"),
            none.alias("offenders"), none.alias("subjects"), F.lit(not rule.mark_only).alias("consumes"), F.lit(rule.weight).alias("w"),
        )
        return F.when(found.isNotNull() | part, sight)

    match = first_match(message, rule.patterns) if rule.patterns else F.struct(F.lit(0).alias("pattern"))
    return F.when(match_type_gate(rule.only, of) & ~ignored(message, rule.ignore), let(match, made))


def _tracked_hits(seen: DataFrame, rules: list[Rule], fields: list[str], tracks_before: DataFrame | None) -> DataFrame:
    """The hits of rules that are party to records, of their sights: the records before a sight are windows over its key, and the
    rule's tests and offenders see what they lift."""
    party = [(k, rule) for k, rule in enumerate(rules) if rule.track]
    kept = [c for c in seen.columns if c != "pattern"]
    seen = seen.withColumns({"_ok": F.col("pattern").isNotNull(), "ord": F.struct("ord", "rule_int")}).drop("pattern", "offenders", "subjects")
    value_of = lambda n: F.try_element_at("data", F.lit(n))
    by_rule = lambda of: F.coalesce(F.lit(None), *(F.when(F.col("rule_int") == k, c) for k, c in of))
    for name in dict.fromkeys(t.name for _, r in party for t in r.track):
        mine = [(k, t) for k, r in party for t in r.track if t.name == name]
        if len({t.ttl for _, t in mine}) > 1:
            raise ValueError(f"the rules give the record {name} more than one ttl")
        whole = lambda key: F.when(key.isNotNull(), F.concat_ws("\x1f", F.col("case_id").cast("string"), key))
        key = by_rule([(k, compound_key([value_of(v) for v in t.key])) for k, t in mine])
        listed = sorted({f for _, t in mine for f in t.fields} | {f for _, r in party for g in r.tracked if g.name == name for f in [*g.into, *(p.field for p in g.where)]})
        columns = {f: f"_f{j}" for j, f in enumerate(listed)}
        adds = {c: by_rule([(k, value_of(f)) for k, t in mine if f in t.fields]).cast("string") for f, c in columns.items()}
        seen = seen.withColumns({"key": whole(key), "harvests": F.lit(True)} | adds)
        seed = None
        if tracks_before is not None:
            old = tracks_before.where(F.col("name") == name)
            seed = old.select(whole(F.col("key")).alias("key"), ((CLOCK_BASE + F.col("ttl").cast("long")) * SECOND).alias("expires"), *(F.try_element_at("fields", F.lit(f)).alias(c) for f, c in columns.items()))
        seen = tracks(seen, list(columns.values()), mine[0][1].ttl, seed)
        stored = {f: F.col(f"before_{c}") for f, c in columns.items()}
        for k, rule in party:
            here = F.col("rule_int") == k
            for g in (g for g in rule.tracked if g.name == name):
                if g.where:
                    holds = F.col("live_before") & all_of([p.column(stored) for p in g.where])
                    seen = seen.withColumn("_ok", F.col("_ok") & (~here | F.col("key").isNull() | holds))
                if g.into:
                    lifted = F.create_map(*(x for f in g.into for x in (F.lit(f), stored[f])))
                    lifted = F.map_filter(lifted, lambda f, v: v.isNotNull() & ~F.map_contains_key("data", f))
                    seen = seen.withColumn("data", F.when(here, F.map_concat("data", lifted)).otherwise(F.col("data")))
            if name in rule.not_tracked:
                seen = seen.withColumn("_ok", F.col("_ok") & ~(here & F.col("live_before")))
        extra = [x for c in columns.values() for x in (c, f"before_{c}", f"after_{c}")]
        seen = seen.drop("key", "harvests", "live_before", *extra)
    passes, offenders, subjects = [], [], []
    listed = lambda vs: F.array(*(value_of(v) for v in vs)).cast("array<string>")
    for k, rule in party:
        names = {*fields, *capture_names(rule.patterns), *(f for g in rule.tracked for f in g.into)}
        passes.append((F.col("rule_int") == k) & gate(rule.tests, {n: value_of(n) for n in names}))
        offenders.append((k, listed(rule.ban_vars)))
        subjects.append((k, listed(rule.detection_vars)))
    mine = seen.where(F.col("_ok") & any_of(passes))
    return mine.withColumns({"offenders": by_rule(offenders), "subjects": by_rule(subjects), "ord": F.col("ord.ord")}).select(kept)
