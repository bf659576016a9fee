"""Gates: rows pass or fall by lookups in small tables. Every gate fails closed unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import addr_equal, ip_in_any, unjoined, v4_number, v6_key
from ..functions.parse import let
from ..functions.scalars import time_fields
from ..sources.scratch import written
from .common import with_value


def drop_ignored(offenders: DataFrame, ignore: DataFrame, ip: str = "ip", exempt: Column | None = None) -> DataFrame:
    """Offenders outside the listed networks; rows of ``exempt`` (detection subjects) stay."""
    seen = ip_in_any(offenders, ip, ignore, "_listed")
    keep = ~F.col("_listed")
    return seen.where(keep if exempt is None else keep | exempt).drop("_listed")


def ban_not_internal(offenders: DataFrame, internal: DataFrame, ip: str = "ip") -> DataFrame:
    """Offender candidates outside one's own networks."""
    return drop_ignored(offenders, internal, ip)


def locate(rows: DataFrame, ip: str, ranges: DataFrame, out: str = "country", ranges6: DataFrame | None = None) -> DataFrame:
    """Add the code of the range that holds the address, or null.

    ``ranges``: (first, last, code) with IPv4 numbers; ``ranges6``: the same with IPv6 addresses as text. Ranges of a family do not
    overlap; one that ends before it begins, or has an end that is no address, holds nothing. Each range is the few
    networks that cover it (62 at most, 254 of IPv6), and an address, looked up once, is asked for in each length of
    prefix that is there: an equality join, in which no task holds all addresses of a region.
    """
    asked = rows.select(F.col(ip).alias("_ip")).where(f"`{ip}` is not null").distinct()
    bits = let(v4_number(F.col("_ip")), lambda n: F.lpad(F.bin(n), 32, "0"))
    found = _in_networks(with_value(asked, bits, "bits"), covers(ranges, 4))
    if ranges6 is not None:
        bits = let(v6_key(F.col("_ip")), lambda k: F.concat(*(F.lpad(F.conv(F.substring(k, 8 * i + 1, 8), 16, 2), 32, "0") for i in range(4))))
        found = found.unionByName(_in_networks(with_value(asked, bits, "bits"), covers(ranges6, 6)))
    keyed = rows.withColumn("_at", unjoined(F.col(ip)))
    return keyed.join(found.select(F.col("_ip").alias("_at"), F.col("code").alias(out)), "_at", "left").select(*rows.columns, out)


def covers(ranges: DataFrame, version: int) -> DataFrame:
    """(prefix, net, code): the least networks that cover each range, ``net`` by the bits of its prefix."""
    kind = ranges.schema["code"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ipaddress

        def nets(first: object, last: object) -> list[tuple[int, str]]:
            try:
                ends = [ipaddress.IPv4Address(int(x)) if version == 4 else ipaddress.IPv6Address(x) for x in (first, last)]
                found = list(ipaddress.summarize_address_range(*ends))
            except (ValueError, TypeError):
                return []
            if found[0].prefixlen == 0:
                found = list(found[0].subnets(new_prefix=1))
            return [(n.prefixlen, f"{int(n.network_address):0{n.max_prefixlen}b}"[: n.prefixlen]) for n in found]

        for batch in batches:
            made = [(p, net, code) for first, last, code in batch.itertuples(index=False, name=None) for p, net in nets(first, last)]
            yield pd.DataFrame(made, columns=["prefix", "net", "code"])

    return ranges.select("first", "last", "code").mapInPandas(run, f"prefix int, net string, code {kind}")


def _in_networks(asked: DataFrame, nets: DataFrame) -> DataFrame:
    """(_ip, code) of each asked address, as ``bits``, in a network."""
    nets = written(nets, "networks")
    lengths = sorted(r.prefix for r in nets.select("prefix").distinct().collect())  # 128 at most
    if not lengths:
        return asked.select("_ip", F.lit(None).cast(nets.schema["code"].dataType).alias("code")).limit(0)
    places = asked.select("_ip", F.explode(F.array(*(F.left("bits", F.lit(p)) for p in lengths))).alias("net"))
    return places.join(nets.select("net", "code"), "net").select("_ip", "code")


def country_gate(rows: DataFrame, ips: list[str], ranges: DataFrame, codes: list[str], negate: bool = False, ranges6: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """Rows all of whose addresses lie in (``negate``: outside) the countries; an address that can't be located fails.

    ``keep`` names a column for the country of the first address, which need not be looked up again then."""
    out = rows
    for k, ip in enumerate(ips):
        out = locate(out, ip, ranges, f"_c{k}", ranges6)
        test = F.col(f"_c{k}").isin(codes)
        out = out.where(~test if negate else test)
    if keep is not None:
        out = out.withColumn(keep, F.col("_c0"))
    return out.drop(*(f"_c{k}" for k in range(len(ips))))


def blocklist_gate(rows: DataFrame, entries: list[tuple[str, list[DataFrame], str]]) -> DataFrame:
    """``entries``: (column, lists, 'cidr', 'string' or 'nocase'). A value must be on any list of each entry; null never is."""
    out = rows
    for col, lists, flavor in entries:
        if not lists:
            return rows.limit(0)
        listed = lists[0].select(F.col(lists[0].columns[0]).alias("entry"))
        for more in lists[1:]:
            listed = listed.union(more.select(more.columns[0]))
        if flavor == "cidr":
            out = ip_in_any(out, col, listed.withColumnRenamed("entry", "cidr"), "_on").where("_on").drop("_on")
        else:
            fold = F.lower if flavor == "nocase" else (lambda c: c)
            out = out.join(listed.select(fold(F.col("entry")).alias("_entry")).distinct(), fold(F.col(col)) == F.col("_entry"), "left_semi")
    return out


def active_time(value: Column, windows: list[dict], negate: bool = False) -> Column:
    """Is the time in a window {days: [0..6] or absent, hours: [(hhmm, hhmm)] or absent}? Ends are inclusive, a start
    later than its end wraps midnight, windows are alternatives. A value that can't be read fails either way."""
    t = time_fields(value)
    hit = F.lit(False)
    for w in windows:
        days = t["weekday"].isin(list(w["days"])) if w.get("days") else F.lit(True)
        hours = F.lit(not w.get("hours"))
        for a, b in w.get("hours") or ():
            hours = hours | (t["hhmm"].between(a, b) if a <= b else (t["hhmm"] >= a) | (t["hhmm"] <= b))
        hit = hit | (days & hours)
    return F.coalesce(t.isNotNull() & (~hit if negate else hit), F.lit(False))


def reverse_dns_gate(rows: DataFrame, ip: str, ptr: DataFrame, forward: DataFrame, pattern: str | None = None, equals: str | None = None, confirm: bool = True, negate: bool = False, on_nxdomain: str = "compare", on_servfail: str = "fail") -> DataFrame:
    """Rows whose address has a name that matches ``pattern`` or equals the column ``equals`` (case and last dot aside).

    ``ptr``: (ip, status 'ok', 'nxdomain' or 'servfail', names); ``forward``: (name, addrs). Names count once their
    addresses hold the address again, unless ``confirm`` is off. Without an answer the status decides.
    """
    plain = lambda c: F.rtrim(F.lower(c), F.lit("."))
    names = ptr.where("status = 'ok'").select(F.col("ip").alias("_ip"), F.explode("names").alias("_n")).withColumn("_name", plain(F.col("_n")))
    if confirm:
        back = forward.select(plain(F.col("name")).alias("_name"), F.explode("addrs").alias("_addr"))
        names = names.join(back, "_name").where(addr_equal(F.col("_ip"), F.col("_addr"))).select("_ip", "_name").distinct()
    names = names.groupBy("_ip").agg(F.collect_set("_name").alias("_names"))  # a handful for an address
    got = rows.join(names, rows[ip] == F.col("_ip"), "left").drop("_ip").join(ptr.select(F.col("ip").alias("_ip"), "status"), rows[ip] == F.col("_ip"), "left").drop("_ip")
    held = F.coalesce(F.col("_names"), F.array().cast("array<string>"))
    test = F.exists(held, lambda n: n.rlike(pattern)) if pattern is not None else F.array_contains(held, F.coalesce(plain(F.col(equals)), F.lit("")))
    compare = ~test if negate else test
    status = F.coalesce(F.col("status"), F.lit("servfail"))
    rule = lambda how: compare if how == "compare" else F.lit(how == "pass")
    verdict = F.when(status == "nxdomain", rule(on_nxdomain)).when(status == "servfail", rule(on_servfail)).otherwise(compare)
    return got.where(verdict).select(rows.columns)


def resolve_hostnames(offenders: DataFrame, hosts: DataFrame, mode: str, max_addrs: int = 4, col: str = "offender", fences: list[DataFrame] | None = None) -> DataFrame:
    """Offenders that are no addresses: 'no' drops them, 'resolve' puts their addresses in their place (none if there are
    more than max_addrs), 'keep' counts by name. ``hosts``: (name, addrs).

    What stands in ``addrs`` and is no address is dropped, and so is what lies in a network of ``fences`` (ignored and
    own ones); offenders that were addresses from the start are left to the gates."""
    if mode == "keep":
        return offenders
    name = F.when(v4_number(F.col(col)).isNull(), F.lower(F.rtrim(F.col(col), F.lit("."))))
    rows = offenders.withColumn("_name", name)
    rows = rows.withColumn("_name", F.when(v6_key(F.col("_name")).isNull(), F.col("_name")))
    if mode == "no":
        return rows.where("_name is null").drop("_name")
    table = hosts.where(F.size("addrs") <= max_addrs).select(F.lower(F.rtrim("name", F.lit("."))).alias("_name"), F.explode(F.array_distinct("addrs")).alias("_addr"))
    table = table.where(v4_number(F.col("_addr")).isNotNull() | v6_key(F.col("_addr")).isNotNull())
    for fence in fences or ():
        table = drop_ignored(table, fence, "_addr")
    named = rows.where("_name is not null").join(table, "_name").withColumn(col, F.col("_addr"))
    return rows.where("_name is null").select(offenders.columns).unionByName(named.select(offenders.columns))


def resolve_ban(crossings: DataFrame, hosts: DataFrame, fences: list[DataFrame], max_addrs: int = 4, col: str = "key") -> DataFrame:
    """Crossings of offenders that were counted by name: each address of the name is banned at the crossing, but for those
    in a network of ``fences``. A name without an answer, or with more than max_addrs addresses, bans nobody."""
    return resolve_hostnames(crossings, hosts, "resolve", max_addrs, col, fences)
