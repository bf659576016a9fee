"""Keyed expiring state as windows: marks, tracked records, correlation.

Mark events: (name, key, us, ord, op 'set' or 'unset', value, ttl). Probes: rows with an id, (key, us, ord). A
probe sees what lies strictly before it in (us, ord); state is live while it expires later than now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SECOND

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def mark_islands(events: DataFrame) -> DataFrame:
    """Add ``expires`` (null for unset) and ``first_set``: when the mark that is live here was first set."""
    order = Window.partitionBy("name", "key").orderBy("us", "ord")
    expires = F.when(F.col("op") == "set", F.col("us") + F.col("ttl").cast("long") * SECOND)
    rows = events.withColumn("expires", F.coalesce("expires", expires) if "expires" in events.columns else expires)
    before = F.lag("expires").over(order)
    fresh = (F.col("op") == "set") & (before.isNull() | (before <= F.col("us")))
    started = F.last(F.when(F.col("_fresh"), F.col("us")), ignorenulls=True).over(order.rowsBetween(*SO_FAR))
    return rows.withColumn("_fresh", fresh).withColumn("first_set", F.when(F.col("op") == "set", started)).drop("_fresh")


def with_marks(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Mark events that begin with the live marks of an earlier run, (name, key, value, first_set, expires) as of ``live_marks``."""
    kinds = dict(events.dtypes)
    old = {"name": F.col("name"), "key": F.col("key"), "us": F.col("first_set"), "op": F.lit("set"), "value": F.col("value")}
    rows = marks.select(*((old.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in events.columns), F.col("expires").alias("expires"))
    return events.withColumn("expires", F.lit(None).cast("long")).unionByName(rows)


def as_of_marks(probes: DataFrame, events: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, name, value, first_set, expires) of the marks that are live for each probe's key, of every name.

    As-of join: events and probes of one key in one window, the last event before the probe decides.
    """
    islands = mark_islands(events).select("name", "key", "us", "ord", F.struct("expires", "value", "first_set").alias("m"), F.lit(None).cast(dict(probes.dtypes)[id_col]).alias("id"))
    asked = _for_each_name(probes, events, id_col)
    seen = islands.unionByName(asked.select("name", "key", "us", "ord", F.lit(None).cast(islands.schema["m"].dataType).alias("m"), "id"))
    order = Window.partitionBy("name", "key").orderBy("us", "ord", F.col("id").isNull())  # of one place the probe comes first
    last = seen.withColumn("m", F.last("m", ignorenulls=True).over(order.rowsBetween(*SO_FAR))).where("id is not null and m.expires > us")
    return last.select("id", "name", "m.value", "m.first_set", "m.expires")


def _for_each_name(probes: DataFrame, events: DataFrame, id_col: str) -> DataFrame:
    names = [r.name for r in events.select("name").distinct().collect()]  # names of marks are those of the rules: few
    return probes.where("key is not null").select("key", "us", "ord", F.col(id_col).alias("id"), F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("name"))


def marked(probes: DataFrame, live: DataFrame, names: list[str], value_is: Column | None = None, id_col: str = "id") -> DataFrame:
    """Probes whose key has a live mark of any name; ``value_is`` (of the probe) must equal the mark's value, both present."""
    mine = live.where(F.col("name").isin(names)).select(F.col("id").alias("_id"), F.col("value").alias("_value"))
    test = F.col(id_col) == F.col("_id")
    if value_is is not None:
        test = test & (F.col("_value") == value_is)
    return probes.join(mine, test, "left_semi")


def not_marked(probes: DataFrame, live: DataFrame, names: list[str], value_not: Column | None = None, id_col: str = "id") -> DataFrame:
    """Probes without a live mark of the names; a null key passes. With ``value_not`` a mark spares the probe only where
    both values are there and differ."""
    mine = live.where(F.col("name").isin(names)).select(F.col("id").alias("_id"), F.col("value").alias("_value"))
    test = F.col(id_col) == F.col("_id")
    if value_not is not None:
        test = test & ~F.coalesce(F.col("_value") != value_not, F.lit(False))
    return probes.join(mine, test, "left_anti")


def sequence(probes: DataFrame, live: DataFrame, names: list[str], id_col: str = "id") -> DataFrame:
    """Probes whose key has all marks live, first set in the order of the list."""
    at = live.where(F.col("name").isin(names)).groupBy(F.col("id").alias("_id")).agg(*(F.max(F.when(F.col("name") == n, F.col("first_set"))).alias(f"_m{k}") for k, n in enumerate(names)))
    ordered = [F.col("_m0").isNotNull()] + [F.col(f"_m{k}") <= F.col(f"_m{k + 1}") for k in range(len(names) - 1)]
    for c in ordered:
        at = at.where(c)
    return probes.join(at, F.col(id_col) == F.col("_id"), "left_semi")


def live_marks(events: DataFrame, as_of: int) -> DataFrame:
    """(name, key, value, first_set, expires) of the marks live at a time."""
    last = mark_islands(events.where(F.col("us") <= as_of)).groupBy("name", "key").agg(F.max_by(F.struct("value", "first_set", "expires"), F.struct("us", "ord")).alias("m"))
    return last.where(F.col("m.expires") > as_of).select("name", "key", "m.*")


def merge_fleet_marks(deltas: DataFrame, as_of: int) -> DataFrame:
    """Fold the changes of many hosts, (name, key, ord, op, value, expires, first_set): after the last unset the latest
    expiry, its value (of equal expiries the greater text) and the earliest first_set; what has expired is dropped."""
    unset = F.max(F.when(F.col("op") == "unset", F.col("ord"))).over(Window.partitionBy("name", "key"))
    rows = deltas.withColumn("_unset", unset).where((F.col("op") == "set") & (F.col("expires") > as_of) & (F.col("_unset").isNull() | (F.col("ord") > F.col("_unset"))))
    return rows.groupBy("name", "key").agg(F.max("expires").alias("expires"), F.min("first_set").alias("first_set"), F.max_by("value", F.struct("expires", F.coalesce("value", F.lit("")))).alias("value"))


def compound_key(parts: list[Column]) -> Column:
    """Key of several fields; null unless each part is there and not empty."""
    there = F.array(*parts)
    return F.when(~F.exists(there, lambda p: p.isNull() | (p == "")), F.array_join(there, "\x1f"))


def tracks(rows: DataFrame, fields: list[str], ttl: int, seed: DataFrame | None = None) -> DataFrame:
    """Add to each row (key, us, ord, harvests boolean, fields...) the track's record: ``before_<f>`` strictly before the
    row, ``after_<f>`` with the row's own harvest, and ``live_before``.

    The newest non-null value of each field wins; each harvest refreshes the record; an expired one begins anew. ``seed``:
    live records (key, expires, fields...) of an earlier run, as of ``live_tracks``.
    """
    types = dict(rows.dtypes)
    if seed is not None:
        old = {"key": F.col("key"), "us": F.col("expires") - ttl * SECOND, "harvests": F.lit(True)} | {f: F.col(f) for f in fields}
        carried = seed.select(*((old.get(c, F.lit(None))).cast(types[c]).alias(c) for c in rows.columns), F.lit(True).alias("_old"))
        return tracks(rows.withColumn("_old", F.lit(False)).unionByName(carried), fields, ttl).where("not _old").drop("_old")
    none = {f"{when}_{f}": F.lit(None).cast(types[f]) for f in fields for when in ("after", "before")}
    without = rows.where("key is null").withColumns({"live_before": F.lit(False)} | none)  # most lines of a log: no part of any window
    rows = rows.where("key is not null")
    order = Window.partitionBy("key").orderBy("us", "ord")
    own = lambda c: F.when(F.col("harvests"), c)
    rows = rows.withColumn("_seen", F.last(own(F.col("us")), ignorenulls=True).over(order.rowsBetween(*BEFORE)))
    rows = rows.withColumn("live_before", F.coalesce(F.col("us") - F.col("_seen") < ttl * SECOND, F.lit(False)))
    begins = F.coalesce(own(~F.col("live_before")), F.lit(False))
    rows = rows.withColumn("_island", F.sum(begins.cast("long")).over(order.rowsBetween(*SO_FAR)))
    inside = Window.partitionBy("key", "_island").orderBy("us", "ord")
    out = rows
    for f in fields:
        after = F.last(own(F.col(f)), ignorenulls=True).over(inside.rowsBetween(*SO_FAR))
        before = F.last(own(F.col(f)), ignorenulls=True).over(inside.rowsBetween(*BEFORE))
        out = out.withColumns({f"after_{f}": F.when(F.col("live_before") | F.col("harvests"), after), f"before_{f}": F.when(F.col("live_before"), before)})
    return out.drop("_seen", "_island").unionByName(without)


def tracked(rows: DataFrame, where: Column | None = None, into: dict[str, str] | None = None) -> DataFrame:
    """Read the record of tracks(): rows without a key pass; with ``where`` a row needs a live record that satisfies it;
    ``into`` lifts fields of the record into columns that the row lacks."""
    out = rows if where is None else rows.where(F.col("key").isNull() | (F.col("live_before") & F.coalesce(where, F.lit(False))))
    for f, target in (into or {}).items():
        lifted = F.col(f"before_{f}")
        out = out.withColumn(target, F.coalesce(F.col(target), lifted) if target in rows.columns else lifted)
    return out


def not_tracked(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("live_before"))


def live_tracks(rows: DataFrame, fields: list[str], ttl: int, as_of: int) -> DataFrame:
    """(key, fields..., expires) of the records live at a time; compound keys come back as ``parts``."""
    seen = tracks(rows.where((F.col("us") <= as_of) & F.col("harvests") & F.col("key").isNotNull()), fields, ttl)
    last = seen.groupBy("key").agg(F.max_by(F.struct(*(F.col(f"after_{f}").alias(f) for f in fields), (F.col("us") + ttl * SECOND).alias("expires")), F.struct("us", "ord")).alias("m"))
    return last.where(F.col("m.expires") > as_of).select("key", F.split("key", "\x1f").alias("parts"), "m.*")


def correlate_context(offenses: DataFrame, captures: DataFrame, fields: list[str], ttl: int, id_col: str = "id") -> DataFrame:
    """Add the fields of the latest capture of the offense's key (backward as-of; a capture of the same line counts).

    ``resolved`` tells a plain offense (null key) or one with a live capture from one that isn't an offense. The
    offense's own fields win.
    """
    return _as_of(offenses, captures, fields, ttl, id_col, forward=False)


def correlate_deferred(offenses: DataFrame, captures: DataFrame, fields: list[str], defer: int, most: int | None = None, id_col: str = "id") -> DataFrame:
    """Offenses that the first later capture of their key completes within ``defer`` seconds: (id, key, us and ord of the
    capture, fields). With ``most``, of the offenses that wait for one capture only so many, the newest, are completed."""
    got = _as_of(offenses.where("key is not null"), captures, fields, defer, id_col, forward=True).where("resolved")
    if most is None:
        return got
    newest = Window.partitionBy("key", "at_us", "at_ord").orderBy(F.desc("us"), F.desc("ord"))
    return got.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")


def _as_of(offenses: DataFrame, captures: DataFrame, fields: list[str], seconds: int, id_col: str, forward: bool) -> DataFrame:
    kept = F.struct(F.col("us").alias("at_us"), F.col("ord").alias("at_ord"), *(F.col(f).alias(f"c_{f}") for f in fields))
    c = captures.where("key is not null").select("key", "us", "ord", kept.alias("c"), F.lit(None).cast(dict(offenses.dtypes)[id_col]).alias("_id"))
    o = offenses.where("key is not null").select("key", "us", "ord", F.lit(None).cast(c.schema["c"].dataType).alias("c"), F.col(id_col).alias("_id"))
    order = Window.partitionBy("key").orderBy("us", "ord", F.col("_id").isNotNull() if not forward else F.col("_id").isNull())
    pick = F.first("c", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)) if forward else F.last("c", ignorenulls=True).over(order.rowsBetween(*SO_FAR))
    hit = (F.col("us") + seconds * SECOND > F.col("p.at_us")) if forward else (F.col("p.at_us") + seconds * SECOND > F.col("us"))
    if forward:  # a capture at the offense's own place was seen with it, not after it
        hit = hit & ((F.col("p.at_us") > F.col("us")) | (F.col("p.at_ord") > F.col("ord")))
    found = c.unionByName(o).withColumn("p", pick).where(F.col("_id").isNotNull() & hit).select("_id", "p.*")
    out = offenses.join(found, F.col(id_col) == F.col("_id"), "left").withColumn("resolved", F.col("key").isNull() | F.col("_id").isNotNull())
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f), F.col(f"c_{f}")) if f in offenses.columns else F.col(f"c_{f}"))
    return out.drop("_id", *(f"c_{f}" for f in fields))
