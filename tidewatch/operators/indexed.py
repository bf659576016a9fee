"""Hundreds of rules on lines: the rules are a table that lines meet by the value of one field, not an expression for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import _GROUP, _HIT, let
from ..functions.predicates import capture_names, checked_regex, compile_tokens, gate, needed_text
from .common import with_value
from .match import Rule

#: Rows of the table of rules up to which it is sent to every task.
BROADCAST_MOST = 100_000
_TABLE = """value string, rule_int int, rule string, pattern int, need string, whole string, written string, groups int,
    names array<struct<name: string, at: array<int>>>, ignore array<struct<need: string, java: string>>, only array<struct<name: string, values: array<string>>>,
    ban_vars array<string>, detection_vars array<string>, consumes boolean, w int, bare boolean"""


def index_field(rules: list[Rule]) -> str | None:
    """The field that most rules pin by ``only``; of several the one with more values, for it leaves a line fewer rules."""
    fields = dict.fromkeys(f for r in rules for f in r.only)
    pinned = lambda f: [r.only[f] for r in rules if f in r.only]
    return max(fields, key=lambda f: (len(pinned(f)), len({v for vs in pinned(f) for v in vs})), default=None)


def rule_table(rules: list[Rule], by: str | None) -> list[tuple]:
    """A row for each value of the field ``by`` and each pattern; value null: the rule is tried on every line."""
    out = []
    for number, r in enumerate(rules):
        names = capture_names(r.patterns)
        ignore = [(needed_text(checked_regex(p)), checked_regex(p)) for p in r.ignore]
        only = [(f, list(vs)) for f, vs in r.only.items() if f != by]
        for k, p in enumerate(r.patterns or [""]):
            java, groups = compile_tokens(p) if r.patterns else ("", [])
            whole = f"(?s)^(?s:.*?)(?-s:{java})(?s:.*)$"
            written = _HIT + _GROUP.join(f"${j + 1}" for j in range(len(groups)))
            listed = [(n, [j + 1 for j, g in enumerate(groups) if g == n]) for n in names]
            row = (number, r.name, k, needed_text(java) if java else "", whole, written, len(groups), listed, ignore, only, r.ban_vars, r.detection_vars, not r.mark_only, r.weight, not r.patterns)
            out += [(v, *row) for v in (dict.fromkeys(r.only[by]) if by in r.only else [None])]
    return out


def match_rules_indexed(lines: DataFrame, rules: list[Rule], message: str, fields: list[str], ids: list[str]) -> DataFrame:
    """The lines that any rule matches, with ``hits`` as ``match_rules`` makes them. ``ids`` tell the lines apart.

    A line meets the rules that name its value of ``index_field``, and those that don't pin that field. What lacks the text
    that a pattern needs goes at once; the rest is sorted by pattern within each task, which so compiles each pattern once.
    Only matches are shuffled. The plan does not grow with the rules, but for those with ``tests``.
    """
    by = index_field(rules)
    table = rule_table(rules, by)
    spark = lines.sparkSession
    rows = lines.withColumns({"_line": F.struct(*lines.columns), "_text": F.col(message), "_of": _map_of(fields)})
    keys = [F.concat(F.lit("="), F.col(by).cast("string"))] if by is not None else []
    keys += [F.lit("*")] if any(t[0] is None for t in table) or not keys else []
    rows = rows.select("_line", "_text", "_of", F.explode(F.array_compact(F.array(*keys))).alias("_key"))
    listed = spark.createDataFrame(table, _TABLE).withColumn("_key", F.coalesce(F.concat(F.lit("="), "value"), F.lit("*"))).drop("value")
    met = rows.join(F.broadcast(listed) if len(table) <= BROADCAST_MOST else listed, "_key")
    met = met.where(F.col("bare") | F.contains("_text", "need"))
    met = met.where(F.forall("only", lambda o: F.coalesce(F.array_contains(o["values"], F.try_element_at("_of", o["name"])), F.lit(False))))
    met = met.withColumn("_text", F.when(F.col("bare"), F.coalesce("_text", F.lit(""))).otherwise(F.col("_text")))
    # explode, not filters: these would be pushed below the sort
    found = with_value(met.sortWithinPartitions("rule_int", "pattern"), _groups(), "_groups")
    vetoed = F.exists("ignore", lambda p: F.contains("_text", p["need"]) & F.regexp_like("_text", p["java"]))
    found = with_value(found, F.when(~F.coalesce(vetoed, F.lit(False)), _data()), "data")
    value_of = lambda n: F.try_element_at("data", F.lit(n))
    for number, r in enumerate(rules):
        if r.tests:
            of = {n: value_of(n) for n in [*fields, *capture_names(r.patterns)]}
            # only a rule's first pattern that matches is judged: what fails keeps its place
            found = found.withColumn("_ok", (F.col("_ok") if "_ok" in found.columns else F.lit(True)) & ((F.col("rule_int") != number) | gate(r.tests, of)))
    ok = F.col("_ok") if "_ok" in found.columns else F.lit(True)
    values = lambda vs: F.transform(vs, lambda v: F.try_element_at("data", v))
    hit = F.struct(
        "rule_int", "rule", "pattern", "data", values("ban_vars").alias("offenders"), values("detection_vars").alias("subjects"), "consumes", "w", ok.alias("ok"),
    )
    line = {c: F.any_value(F.col(f"_line.{c}")).alias(c) for c in lines.columns if c not in ids}
    grouped = found.withColumn("_hit", hit).groupBy(*(F.col(f"_line.{c}").alias(c) for c in ids)).agg(*line.values(), F.collect_list("_hit").alias("hits"))  # as many as there are patterns, at most
    place = lambda h: h["rule_int"] * 100_000 + h["pattern"]
    ordered = F.array_sort("hits", lambda a, b: F.signum(place(a) - place(b)).cast("int"))
    first = lambda hs: F.filter(hs, lambda h, k: h["ok"] & ((k == 0) | (F.get(hs, k - 1)["rule_int"] != h["rule_int"])))
    judged = F.transform(let(ordered, first), lambda h: h.dropFields("ok"))
    return grouped.withColumn("hits", judged).where(F.size("hits") > 0).select(*lines.columns, "hits")


def _map_of(fields: list[str]) -> Column:
    return F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string")))) if fields else F.create_map().cast("map<string,string>")


def _groups() -> Column:
    """The groups of a row's pattern, empty and absent ones null; null if it does not match."""
    text, n = F.col("_text"), F.col("groups")
    empty = lambda a: F.transform(a, lambda x: F.nullif(x, F.lit("")))
    split = let(F.regexp_replace(text, F.col("whole"), F.col("written")), lambda w: F.when(w.startswith(_HIT), empty(F.slice(F.split(w, f"[{_HIT}{_GROUP}]", n + 1), 2, n))))
    each = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda k: F.call_function("regexp_extract", text, F.col("whole"), k)))
    forging = F.contains(text, F.lit(_HIT)) | F.contains(text, F.lit(_GROUP))
    return F.when(forging, F.when(F.regexp_like(text, F.col("whole")), empty(each))).otherwise(split)


def _data() -> Column:
    """Fields of the record, and the captures, which take the place of fields of their name even where they are absent."""
    value = lambda n: F.get(F.filter(F.transform(n["at"], lambda k: F.get("_groups", k - 1)), lambda x: x.isNotNull()), 0)
    captured = F.filter(F.transform("names", lambda n: F.struct(n["name"].alias("key"), value(n).alias("value"))), lambda e: e["value"].isNotNull())
    own = F.map_filter("_of", lambda k, v: v.isNotNull() & ~F.exists("names", lambda n: n["name"] == k))
    return F.map_concat(own, F.map_from_entries(captured))
