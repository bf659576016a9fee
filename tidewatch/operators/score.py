"""Counting offenders in trailing windows: scores, crossings, distinct values, networks, repeat offenders.

Hits have the columns ``bucket``, ``key``, ``us`` (epoch microseconds), ``ord`` (unique order) and ``w``
(weight). A hit counts while it is younger than ``find_time`` seconds; hits of one moment count in the
order of ``ord``.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ip import ip_network, v6_network
from .common import SECOND, ordered_fold, time_blocks, with_value


def bucket_choice(kur: Column, rule: Column, overridden: Column, observing: Column) -> Column:
    """The counter a hit goes to: the kur's own, a rule's own where its thresholds differ, or their shadows."""
    own = F.when(overridden, F.concat_ws(":", F.lit("rule"), kur, rule)).otherwise(F.concat_ws(":", F.lit("kur"), kur))
    return F.when(observing, F.concat(F.lit("shadow:"), own)).otherwise(own)


def effective_thresholds(hits: DataFrame, settings: DataFrame, layers: list[str], names: list[str]) -> DataFrame:
    """For each setting the first layer that names it. ``settings``: (layer, id, settings...), a small table;
    ``layers``: columns of ``hits`` that hold the id of each layer, the most specific first."""
    out = hits
    for layer in layers:
        mine = settings.where(F.col("layer") == layer).select(F.col("id").alias(f"_{layer}_id"), *(F.col(n).alias(f"_{layer}_{n}") for n in names))
        out = out.join(mine, F.col(layer) == F.col(f"_{layer}_id"), "left")
    out = out.withColumns({n: F.coalesce(*(F.col(f"_{layer}_{n}") for layer in layers)) for n in names})
    return out.drop(*(f"_{layer}_{n}" for layer in layers for n in ("id", *names)))


def _trailing_sum(keys: list[str], find_time: int) -> Column:
    """Weights within find_time up to and with each hit of ``keys``, of hits of one moment in the order of ``ord``."""
    range_sum = F.sum("w").over(Window.partitionBy(*keys).orderBy("us").rangeBetween(-(find_time * SECOND - 1), 0))
    # the range holds hits of the same moment that come later in order
    later = F.sum("w").over(Window.partitionBy(*keys, "us").orderBy("ord").rowsBetween(1, Window.unboundedFollowing))
    return range_sum - F.coalesce(later, F.lit(0))


def sliding_score(hits: DataFrame, find_time: int) -> DataFrame:
    """Add ``score``: weights of the key's hits within find_time up to and with this one, without resets (``event_scores`` has
    them). Summed in blocks of time, each with what it still sees of the block before, so that a popular key is many tasks."""
    blocks = time_blocks(hits, find_time)
    return blocks.withColumn("score", _trailing_sum(["bucket", "key", "_block"], find_time)).where("_own").drop("_block", "_own")


def with_thresholds(hits: DataFrame, find_time: int | None, max_score: int | None) -> DataFrame:
    """Hits with the thresholds that each races as columns find_time and max_score: those given, or the hit's own."""
    return hits.withColumns({n: (F.col(n) if v is None else F.lit(v)).cast("long") for n, v in (("find_time", find_time), ("max_score", max_score))})


def with_carried(hits: DataFrame, seed: DataFrame | None, cols: list[str]) -> DataFrame:
    """``cols`` of hits, and of what an earlier run has left: those rows count, but were judged then (``_old``)."""
    rows = hits.select(*cols, F.lit(False).alias("_old"))
    if seed is None:
        return rows
    kinds = dict(hits.dtypes)
    old = [(F.col(c) if c in seed.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in cols if c in kinds]
    return rows.unionByName(seed.select(*old, F.lit(True).alias("_old")))


def live_hits(hits: DataFrame, crossings: DataFrame | None, find_time: int, as_of: int) -> DataFrame:
    """The hits up to ``as_of`` that a later one may still see: within find_time, and after the key's last crossing. What a
    snapshot keeps for the next run."""
    rows = hits.where((F.col("us") <= as_of) & (F.col("us") > as_of - find_time * SECOND))
    if crossings is None:
        return rows
    last = crossings.where(F.col("us") <= as_of).groupBy("bucket", "key").agg(F.max(F.struct("us", "ord")).alias("_cross"))
    return rows.join(last, ["bucket", "key"], "left").where(F.col("_cross").isNull() | (F.struct("us", "ord") > F.col("_cross"))).drop("_cross")


def sessions(hits: DataFrame, find_time: int | None = None) -> DataFrame:
    """Add ``session``: a hit that comes its find_time or more after the one before finds an empty bucket, whatever the
    find_time of the others, so what lies on its sides can be counted apart."""
    span = F.col("find_time") * SECOND if find_time is None else F.lit(find_time * SECOND)
    order = Window.partitionBy("bucket", "key").orderBy("us", "ord")
    opens = F.coalesce(F.col("us") - F.lag("us").over(order) >= span, F.lit(True))
    return hits.withColumn("_opens", opens.cast("long")).withColumn("session", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def can_cross(split: DataFrame, total: Column, max_score: int | None = None) -> DataFrame:
    """Rows of sessions whose whole ``total`` reaches the lowest max_score of its hits: no hit of the others can."""
    return _judged_sessions(split, total, max_score).where("_can").drop("_can")


def _judged_sessions(split: DataFrame, total: Column, max_score: int | None) -> DataFrame:
    session = Window.partitionBy("bucket", "key", "session")
    least = F.min("max_score").over(session) if max_score is None else F.lit(max_score)
    return split.withColumn("_can", total.over(session) >= least)


def _bucket_step(state: list, us: int, w: int, find_time: int, max_score: int, old: bool) -> tuple[int, bool]:
    """Score of a hit and whether it crosses. ``state``: the live hits and their sum. Of hits in the order of time those
    are let go that this one no longer sees, for good, even if a later hit has a longer find_time."""
    live, span = state[0], find_time * SECOND
    live.append((us, w))
    state[1] += w
    while live and us - live[0][0] >= span:
        state[1] -= live.popleft()[1]
    score = state[1]
    crossed = not old and score >= max_score
    if crossed:
        live.clear()
        state[1] = 0
    return score, crossed


_SCORED = ["bucket", "key", "us", "ord", "w", "find_time", "max_score"]


def threshold_crossings(hits: DataFrame, find_time: int | None = None, max_score: int | None = None, seed: DataFrame | None = None) -> DataFrame:
    """(bucket, key, us, ord, score) of each hit that reaches max_score; a crossing empties the bucket.

    Without ``find_time`` or ``max_score`` each hit races its own, from columns of these names (``effective_thresholds``).
    ``seed``: hits that an earlier run has left live (``live_hits``)."""
    rows = with_carried(with_thresholds(hits, find_time, max_score), _seeded(seed, find_time, max_score), _SCORED)
    can = can_cross(sessions(rows, find_time), F.sum("w"), max_score)

    def step(state: list, row: tuple) -> list[tuple]:
        bucket, key, us, order, w, span, most, old, _ = row
        score, crossed = _bucket_step(state, us, w, span, most, old)
        return [(bucket, key, us, order, score)] if crossed else []

    return ordered_fold(can, ["bucket", "key", "session"], ["us", "ord"], lambda: [deque(), 0], step, f"bucket string, key {dict(hits.dtypes)['key']}, us long, ord long, score {dict(hits.dtypes)['w']}")


def _seeded(seed: DataFrame | None, find_time: int | None, max_score: int | None) -> DataFrame | None:
    return None if seed is None else with_thresholds(seed, find_time, max_score)


def event_scores(hits: DataFrame, find_time: int | None = None, max_score: int | None = None, seed: DataFrame | None = None) -> DataFrame:
    """(bucket, key, us, ord, score, crossed, threshold) of every hit, as its event carries them: after a crossing the score
    begins anew, and the threshold is the hit's own. Thresholds as for ``threshold_crossings``.

    Sessions that can't cross are window sums, the others are folded; where each hit has a find_time of its own all are.
    """
    kind = dict(hits.dtypes)
    rows = with_carried(with_thresholds(hits, find_time, max_score), _seeded(seed, find_time, max_score), _SCORED)
    rows = _judged_sessions(sessions(rows, find_time), F.sum("w"), max_score)

    def step(state: list, row: tuple) -> list[tuple]:
        bucket, key, us, order, w, span, most, old = row[:8]
        made = _bucket_step(state, us, w, span, most, old)
        return [] if old else [(bucket, key, us, order, *made, most)]

    schema = f"bucket string, key {kind['key']}, us long, ord long, score {kind['w']}, crossed boolean, threshold long"
    fold = lambda df: ordered_fold(df, ["bucket", "key", "session"], ["us", "ord"], lambda: [deque(), 0], step, schema)
    if find_time is None:
        return fold(rows.drop("_can"))
    session = ["bucket", "key", "session"]
    calm = rows.where("not _can").withColumn("score", _trailing_sum(session, find_time))
    calm = calm.where("not _old").select("bucket", "key", "us", "ord", F.col("score").cast(kind["w"]).alias("score"), F.lit(False).alias("crossed"), F.col("max_score").cast("long").alias("threshold"))
    return calm.unionByName(fold(rows.where("_can").drop("_can")))


def _valued() -> Column:
    return F.coalesce(F.col("of") != "", F.lit(False))


def _keyed(hits: DataFrame) -> DataFrame:
    return hits.where(F.coalesce(F.col("key").cast("string") != "", F.lit(False)))


def distinct_scores(hits: DataFrame, find_time: int, max_score: int | None = None, crossings_only: bool = False, seed: DataFrame | None = None) -> DataFrame:
    """(bucket, key, us, ord, score, crossed): number of different ``of`` values last seen within find_time.

    A hit without a value (null or empty) adds none, but is judged by the set as it is, and crosses if that is full; one without
    a key is not counted. With max_score a hit that reaches it crosses and empties the set; without, nothing is emptied (counting
    values of one key by another). Stretches between gaps are folded apart; with ``crossings_only`` those with
    fewer values than max_score are pruned. ``seed``: sights that an earlier run has left live.
    """
    rows = sessions(with_carried(_keyed(hits), seed, ["bucket", "key", "us", "ord", "of"]), find_time)
    if crossings_only:
        rows = can_cross(rows, F.count_if(_valued()), max_score)
    span = find_time * SECOND

    def step(seen: dict, row: tuple) -> list[tuple]:
        bucket, key, us, order, of, old, _ = row
        score = see(seen, of, us, span)
        if old:
            return []
        crossed = max_score is not None and score >= max_score
        if crossed:
            seen.clear()
        return [(bucket, key, us, order, score, crossed)] if crossed or not crossings_only else []

    return ordered_fold(rows, ["bucket", "key", "session"], ["us", "ord"], dict, step, f"bucket string, key {dict(hits.dtypes)['key']}, us long, ord long, score long, crossed boolean")


def see(seen: dict, of: str | None, us: int, span: int) -> int:
    """Number of values that are live with this sight. ``seen``: value -> last sight, in that order."""
    if of:
        seen.pop(of, None)
        seen[of] = us
    while seen and us - next(iter(seen.values())) >= span:
        del seen[next(iter(seen))]
    return len(seen)


def value_counts(hits: DataFrame, find_time: int, max_score: int, seed: DataFrame | None = None) -> DataFrame:
    """Hits (key: the counted-by value; ``of``: counted; ``offender``) whose key's set has max_score values: each is a ban row.

    A hit without a value adds none and is judged by the set as it is; one without a key is not counted. A ban of the
    key itself (offender = key) empties its set; bans of others leave it.

    Keys that never are the offender are never emptied: a value counts from its sight until find_time after, or until its next
    sight, so the count is a running sum of arrivals and expiries. It is taken in blocks of time, each with what is still
    live from the block before, so that a popular key is many tasks. Keys that are the offender somewhere are folded.
    ``seed``: sights that an earlier run has left live.
    """
    kinds = dict(hits.dtypes)
    own = F.coalesce(F.col("key").cast("string") == F.col("offender").cast("string"), F.lit(False))
    rows = with_carried(_keyed(hits), seed, ["bucket", "key", "us", "ord", "of", "offender"])
    selves = rows.where(own).select("bucket", "key").distinct()
    blocks = time_blocks(rows.join(selves, ["bucket", "key"], "left_anti"), find_time).withColumn("_own", F.col("_own") & ~F.col("_old"))
    key = ["bucket", "key", "_block"]
    span = find_time * SECOND
    by_value = Window.partitionBy(*key, "of").orderBy("us", "ord")
    valued = blocks.where(_valued()).withColumn("_next", F.lead("us").over(by_value)).withColumn("_last", F.lag("us").over(by_value))
    arrives = F.when(F.col("_last").isNull() | (F.col("us") - F.col("_last") >= span), 1).otherwise(0)
    leaves = F.when(F.col("_next").isNull() | (F.col("_next") - F.col("us") >= span), F.col("us") + span)
    up = valued.select(*key, "_own", "us", "ord", "offender", F.lit(1).alias("_kind"), arrives.alias("_d"))
    probes = blocks.where(~_valued()).select(*key, "_own", "us", "ord", "offender", F.lit(1).alias("_kind"), F.lit(0).alias("_d"))
    down = valued.select(*key, F.lit(False).alias("_own"), leaves.alias("us"), "ord", F.lit(None).cast(kinds["offender"]).alias("offender"), F.lit(0).alias("_kind"), F.lit(-1).alias("_d")).where("us is not null")
    running = F.sum("_d").over(Window.partitionBy(*key).orderBy("us", "_kind", "ord").rowsBetween(Window.unboundedPreceding, 0))
    plain = up.unionByName(probes).unionByName(down).withColumn("score", running).where(F.col("_own") & (F.col("score") >= max_score))

    def step(seen: dict, row: tuple) -> list[tuple]:
        bucket, mine, us, order, of, offender, old, _ = row
        score = see(seen, of, us, span)
        if old or score < max_score:
            return []
        if str(mine) == str(offender):
            seen.clear()
        return [(bucket, mine, us, order, offender, score)]

    folded = can_cross(sessions(rows.join(selves, ["bucket", "key"], "left_semi"), find_time), F.count_if(_valued()), max_score)
    schema = f"bucket string, key {kinds['key']}, us long, ord long, offender {kinds['offender']}, score long"
    folded = ordered_fold(folded, ["bucket", "key", "session"], ["us", "ord"], dict, step, schema)
    return plain.select("bucket", "key", "us", "ord", "offender", "score").unionByName(folded)


def _networks(prefix_v4: int, prefix_v6: int | None) -> Column:
    net = ip_network(F.col("key"), F.lit(prefix_v4), with_v6=False)
    if prefix_v6 is None:
        return net
    return F.coalesce(net, v6_network(F.col("key"), F.lit(prefix_v6)))


def subnet_deposits(hits: DataFrame, prefix_v4: int, prefix_v6: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Hits (key: address) re-keyed on their networks: (bucket, key, us, ord, w, member, columns of ``keep``). IPv6 only with
    a ``prefix_v6``."""
    nets = with_value(hits, _networks(prefix_v4, prefix_v6), "_net")
    return nets.select("bucket", F.col("_net").alias("key"), "us", "ord", "w", F.col("key").alias("member"), *(keep or ()))


def subnet_crossings(hits: DataFrame, prefix_v4: int, find_time: int, max_score: int, prefix_v6: int | None = None, seed: DataFrame | None = None) -> DataFrame:
    """Hits (key: address) counted by network: (bucket, cidr, us, ord, score, hits, members, first, last) of crossings.

    IPv6 addresses are counted only with a ``prefix_v6``. ``members`` are the different addresses of the window in the
    order of first sight. Stretches between gaps are folded apart, and those that cannot cross are pruned. ``seed``: deposits
    that an earlier run has left live.
    """
    rows = with_carried(subnet_deposits(hits, prefix_v4, prefix_v6), seed, ["bucket", "key", "us", "ord", "w", "member"])
    rows = can_cross(sessions(rows, find_time), F.sum("w"), max_score)
    span = find_time * SECOND

    def step(state: list, row: tuple) -> list[tuple]:
        live, (bucket, net, us, order, w, ip, old, _) = state[0], row
        while live and us - live[0][0] >= span:
            state[1] -= live.popleft()[1]
        live.append((us, w, ip))
        state[1] += w
        if old or state[1] < max_score:
            return []
        out = (bucket, net, us, order, state[1], len(live), list(dict.fromkeys(x[2] for x in live)), live[0][0], us)
        live.clear()
        state[1] = 0
        return [out]

    return ordered_fold(rows, ["bucket", "key", "session"], ["us", "ord"], lambda: [deque(), 0], step, "bucket string, cidr string, us long, ord long, score long, hits long, members array<string>, first long, last long")


def recidive(ledger: DataFrame, find_time: int = 604_800, max_score: int = 5, kur: str = "recidive") -> DataFrame:
    """Ledger rows (ord, us, kur, ip) whose address has max_score bans within find_time, this one included, over all
    kurs but the escalating one itself. No reset: each ban while over escalates."""
    rows = ledger.where(F.col("kur") != kur)
    count = F.count("*").over(Window.partitionBy("ip").orderBy("us").rangeBetween(-(find_time * SECOND - 1), 0))
    later = F.count("*").over(Window.partitionBy("ip", "us").orderBy("ord").rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("count", count - later).where(F.col("count") >= max_score)


def accused(hits: DataFrame, crossings: DataFrame, find_time: int, as_of: int, idle: int = 86_400) -> DataFrame:
    """(bucket, key, rule, hits, score, first, last): what each key has outstanding, in all (rule null) and by rule.

    Hits since the key's last crossing, within find_time of its last hit; keys idle for a day are gone.
    """
    last_cross = crossings.where(F.col("us") <= as_of).groupBy("bucket", "key").agg(F.max(F.struct("us", "ord")).alias("_cross"))
    rows = hits.where(F.col("us") <= as_of).join(last_cross, ["bucket", "key"], "left").where(F.col("_cross").isNull() | (F.struct("us", "ord") > F.col("_cross")))
    rows = rows.withColumn("_last", F.max("us").over(Window.partitionBy("bucket", "key")))
    rows = rows.where((F.col("_last") - F.col("us") < find_time * SECOND) & (as_of - F.col("_last") <= idle * SECOND))
    sums = [F.count("*").alias("hits"), F.sum("w").alias("score"), F.min("us").alias("first"), F.max("us").alias("last")]
    return rows.groupingSets([[F.col("bucket"), F.col("key")], [F.col("bucket"), F.col("key"), F.col("rule")]], "bucket", "key", "rule").agg(*sums)


def tracked_counts(hits: DataFrame, prefix_v4: int = 24, prefix_v6: int | None = None) -> DataFrame:
    """Different offenders and networks that are counted, per bucket; IPv6 networks only with a ``prefix_v6``."""
    keys = hits.select("bucket", "key").distinct()
    return keys.withColumn("_net", _networks(prefix_v4, prefix_v6)).groupBy("bucket").agg(F.count("key").alias("offenders"), F.count_distinct("_net").alias("subnets"))
