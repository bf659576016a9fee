"""Ordered, counted stages per key: a fold over each key's matching lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SECOND, ordered_fold


@dataclass
class Stage:
    """``count`` hits of the stage's name, each less than ``within`` seconds after the one before, with at most ``skip``
    other lines of the key between (None: any number)."""

    name: str
    count: int = 1
    within: int = 600
    skip: int | None = None


def staged_sequence(lines: DataFrame, stages: list[Stage]) -> DataFrame:
    """(key, us, ord, hits, data) of each completed sequence. ``lines``: (key, us, ord, stage name or null for other lines,
    data: the line's captures as a map, or no such column).

    ``data`` merges the captures of the sequence's lines; of a field that several have, the last wins.

    A line that comes too late kills the sequence and may start one anew; a line of the first stage never
    restarts a live sequence. ``hits`` lists (stage, us, ord). Keys without a hit of the last stage are pruned.
    """
    last = stages[-1].name
    if "data" not in lines.columns:
        lines = lines.withColumn("data", F.lit(None).cast("map<string,string>"))
    has = F.max((F.col("stage") == last).cast("int")).over(Window.partitionBy("key"))
    rows = lines.where("key is not null").withColumn("_has", has).where("_has = 1").select("key", "us", "ord", "stage", "data")

    def step(state: dict, row: tuple) -> list[tuple]:
        key, us, order, stage, data = row
        state["seq"] += 1
        if state["hits"]:
            want = stages[state["at"]]
            late = us - state["hits"][-1]["us"] >= want.within * SECOND
            skipped = want.skip is not None and state["seq"] - state["seen"] - 1 > want.skip
            if late or skipped:
                state |= {"hits": [], "at": 0, "n": 0, "data": {}}
        if stage != stages[state["at"]].name:
            return []
        state["hits"].append({"stage": stage, "us": us, "ord": order})
        state["data"] |= {k: v for k, v in dict(data if data is not None else {}).items() if v is not None}
        state["n"] += 1
        state["seen"] = state["seq"]
        if state["n"] < stages[state["at"]].count:
            return []
        state |= {"at": state["at"] + 1, "n": 0}
        if state["at"] < len(stages):
            return []
        hits, merged = state["hits"], state["data"]
        state |= {"hits": [], "at": 0, "n": 0, "data": {}}
        return [(key, us, order, hits, merged)]

    def start() -> dict:
        return {"hits": [], "at": 0, "n": 0, "seq": 0, "seen": 0, "data": {}}

    key_type = dict(lines.dtypes)["key"]
    return ordered_fold(rows, ["key"], ["us", "ord"], start, step, f"key {key_type}, us long, ord long, hits array<struct<stage:string,us:long,ord:long>>, data map<string,string>")
