"""Addresses and networks as built-in columns: IPv4 is a number, IPv6 its 32 hex digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse import let

_V4 = r"^(?:::ffff:)?(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def v4_number(ip: Column) -> Column:
    """The 32 bits of an IPv4 address (plain or mapped into IPv6) as a long, else null."""
    octets = lambda x: F.split(F.substring_index(x, ":", -1), r"\.")
    return let(ip, lambda x: F.when(F.lower(x).rlike(_V4), F.aggregate(octets(x), F.lit(0).cast("long"), lambda acc, o: acc * 256 + o.try_cast("long"))))


def v4_text(number: Column) -> Column:
    octet = lambda n, k: F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string")
    dot = F.lit(".")
    return let(number, lambda n: F.concat(octet(n, 24), dot, octet(n, 16), dot, octet(n, 8), dot, octet(n, 0)))


_TAIL = r"^([0-9a-f:]*:)(\d{1,3}(?:\.\d{1,3}){3})$"


def v6_key(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address that isn't mapped IPv4, else null: their order is that of the addresses."""

    def with_groups(x: Column) -> Column:
        four = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
        tail = let(v4_number(F.regexp_extract(x, _TAIL, 2)), lambda n: F.concat(F.regexp_extract(x, _TAIL, 1), four(n)))
        return let(F.when(x.contains("."), tail).otherwise(x), digits)

    def digits(x: Column) -> Column:
        groups = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))
        wide = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
        right = lambda gs: F.forall(gs, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        whole = let(F.split(x, ":"), lambda gs: F.when((F.size(gs) == 8) & right(gs), wide(gs)))

        def joined(halves: Column) -> Column:
            both = F.struct(groups(halves[0]).alias("a"), groups(halves[1]).alias("b"))
            fill = lambda h: F.concat(wide(h["a"]), F.repeat(F.lit("0000"), 8 - F.size(h["a"]) - F.size(h["b"])), wide(h["b"]))
            return let(both, lambda h: F.when((F.size(h["a"]) + F.size(h["b"]) <= 7) & right(h["a"]) & right(h["b"]), fill(h)))

        return let(F.split(x, "::"), lambda halves: F.when(F.size(halves) == 1, whole).when(F.size(halves) == 2, joined(halves)))

    key = let(F.when(ip.contains(":") & (F.char_length(ip) <= 45), F.lower(ip)), lambda x: F.when(x.isNotNull(), with_groups(x)))
    return let(key, lambda k: F.when(~k.startswith("0" * 20 + "ffff"), k))


def v6_text(key: Column) -> Column:
    """The shortest form of a v6_key: the first of the longest runs of zero groups is left out."""

    def shortest(y: Column) -> Column:  # with a colon at both ends
        longest = F.array_max(F.transform(F.regexp_extract_all(y, F.lit("(?<=:)(?:0:){2,}"), F.lit(0)), F.char_length))

        def without(n: Column) -> Column:
            at = F.call_function("instr", y, F.concat(F.lit(":"), F.repeat(F.lit("0:"), (n / 2).cast("int"))))
            rest = F.rtrim(F.substring(y, at + n + 1, F.lit(45)), F.lit(":"))
            return F.when(n.isNull(), F.substring(y, F.lit(2), F.char_length(y) - 2)).otherwise(F.concat(F.substring(y, F.lit(2), at - 2), F.lit("::"), rest))

        return let(longest, without)

    group = lambda k, i: F.ltrim(F.substring(k, 4 * i + 1, 3), F.lit("0"))  # noqa: E731  without its last digit
    return let(key, lambda k: F.when(k.isNotNull(), let(F.concat(*(x for i in range(8) for x in (F.lit(":"), group(k, i), F.substring(k, 4 * i + 4, 1))), F.lit(":")), shortest)))


def v6_canonical(ip: Column) -> Column:
    """The shortest lower-case form of an IPv6 address that isn't mapped IPv4, else null."""
    return v6_text(v6_key(ip))


def v6_masked(key: Column, prefix: Column) -> Column:
    """The first address of the network, as a v6_key; null for prefixes outside 1 to 128."""
    whole, rest = F.floor(prefix / 4).cast("int"), F.pmod(prefix, F.lit(4)).cast("int")
    digit = F.conv(F.substring(key, whole + 1, F.lit(1)), 16, 10).cast("int").bitwiseAND(F.element_at(F.array(*map(F.lit, (0, 8, 12, 14))), rest + 1))
    partly = F.when(rest > 0, F.lower(F.hex(digit.cast("long")))).otherwise("")
    return F.when(prefix.between(1, 128), F.rpad(F.concat(F.left(key, whole), partly), 32, "0"))


def v6_network(ip: Column, prefix: Column) -> Column:
    """The CIDR text of an IPv6 address's network, or null."""
    return F.concat(v6_text(let(v6_key(ip), lambda k: v6_masked(k, prefix))), F.lit("/"), prefix.cast("string"))


def ip_family(ip: Column, with_v6: bool = True) -> Column:
    """v4, v6 or null; IPv4 mapped into IPv6 counts as v4."""
    v4 = F.when(v4_number(ip).isNotNull(), "v4")
    return F.coalesce(v4, F.when(v6_key(ip).isNotNull(), "v6")) if with_v6 else v4


def v4_network(number: Column, prefix: Column) -> Column:
    """First address, as a number, of the network of ``prefix`` bits (1 to 32)."""
    size = F.pow(F.lit(2.0), 32 - prefix).cast("long")
    return F.when(prefix.between(1, 32), number - F.pmod(number, size))


def ip_network(ip: Column, prefix: Column, with_v6: bool = True) -> Column:
    """The CIDR text of the address's network; null for prefixes outside 1 to 32 (1 to 128) and non-addresses."""
    v4 = F.concat(v4_text(v4_network(v4_number(ip), prefix)), F.lit("/"), prefix.cast("string"))
    return F.coalesce(v4, v6_network(ip, prefix)) if with_v6 else v4


def addr_equal(a: Column, b: Column) -> Column:
    """Equality by value within a family; false if a side isn't an address."""
    canonical = lambda x: F.coalesce(v4_text(v4_number(x)), v6_canonical(x))
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def v6_prefix(key: Column, prefix: Column) -> Column:
    """The hex digits that hold the first ``prefix`` bits: equal for the addresses of one network."""
    return F.left(v6_masked(key, prefix), F.ceil(prefix / 4).cast("int"))


def split_cidrs(cidrs: DataFrame, col: str = "cidr") -> DataFrame:
    """(family, prefix, net): listed networks, v4 by the number of the first address, v6 by the hex digits that hold the prefix.

    A bare address is a network of its own; entries that aren't networks are dropped."""
    halves = F.split(F.trim(col), "/")
    ip, given = F.element_at(halves, 1), F.try_element_at(halves, F.lit(2)).try_cast("int")
    rows = cidrs.select(ip.alias("ip"), given.alias("given"), (F.instr(col, "/") > 0).alias("slash")).where("not slash or given is not null")
    v4 = rows.withColumn("n", v4_number(F.col("ip"))).withColumn("prefix", F.coalesce("given", F.lit(32)))
    v4 = v4.select(F.lit("v4").alias("family"), "prefix", v4_network(F.col("n"), F.col("prefix")).cast("string").alias("net")).where("net is not null")
    v6 = rows.where("ip like '%:%'").withColumn("prefix", F.coalesce("given", F.lit(128)))
    v6 = v6.select(F.lit("v6").alias("family"), "prefix", let(v6_key(F.col("ip")), lambda k: v6_prefix(k, F.col("prefix"))).alias("net")).where("net is not null")
    return v4.unionByName(v6).distinct()


def unjoined(key: Column) -> Column:
    """A join key for a text that may be null: null ones, which match nothing, are spread over many partitions."""
    return F.coalesce(key, F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(1009)).cast("string")))


def ip_in_any(rows: DataFrame, ip: str, cidrs: DataFrame, out: str, with_v6: bool = True) -> DataFrame:
    """Add the boolean ``out``: is the address in a listed network of its family? Non-addresses never are.

    The list's prefix lengths are few: each address gives its network of every length once, and the rest
    is an equality join, not a scan of ranges.
    """
    nets = split_cidrs(cidrs)
    lengths: dict[str, list[int]] = {"v4": [], "v6": []}
    for r in nets.select("family", "prefix").distinct().collect():  # 32 and 128 at most
        lengths[r.family].append(r.prefix)
    listed = nets.select(F.concat_ws("/", "family", "prefix", "net").alias("_net"))
    # distinct addresses, then their networks: the large side is joined once, on the address
    found = rows.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct().withColumn("_number", v4_number(F.col("_ip")))
    keys = [F.concat_ws("/", F.lit("v4"), F.lit(p), v4_network(F.col("_number"), F.lit(p)).cast("string")) for p in sorted(lengths["v4"])]
    if with_v6 and lengths["v6"]:
        found = found.withColumn("_key", v6_key(F.col("_ip")))
        keys += [F.concat_ws("/", F.lit("v6"), F.lit(p), v6_prefix(F.col("_key"), F.lit(p))) for p in sorted(lengths["v6"])]
    if not keys:
        return rows.withColumn(out, F.lit(False))
    found = found.select("_ip", F.explode(F.array(*keys)).alias("_net")).join(listed, "_net", "left_semi").select("_ip").distinct().withColumn("_in", F.lit(True))
    keyed = rows.withColumn("_at", unjoined(F.col(ip)))
    return keyed.join(found.withColumnRenamed("_ip", "_at"), "_at", "left").select(*rows.columns, F.coalesce("_in", F.lit(False)).alias(out))
