"""Places of addresses by the networks that cover their ranges."""

from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from tidewatch.functions.ip import ip_in_any
from tidewatch.operators import gates


def test_ranges_by_hand(spark):
    rng = random.Random(8)
    cuts = sorted(rng.sample(range(1, 2**32 - 1), 60))
    four = [(a, b - 1, f"c{k % 7}") for k, (a, b) in enumerate(zip(cuts[::2], cuts[1::2], strict=True))] + [(5, 4, "none"), (None, 9, "none")]
    cuts6 = sorted({rng.randrange(2**125, 2**127) for _ in range(40)})
    six = [(str(ipaddress.IPv6Address(a)), str(ipaddress.IPv6Address(b - 1)), f"d{k % 5}") for k, (a, b) in enumerate(zip(cuts6[::2], cuts6[1::2], strict=True))] + [("junk", "::5", "none"), ("2000::", None, "none")]
    asked = [ipaddress.IPv4Address(x) for x in [*(y for r in four[:-2] for y in (r[0] - 1, r[0], r[1], r[1] + 1)), *(rng.randrange(2**32) for _ in range(200))]]
    asked6 = [ipaddress.IPv6Address(x) for x in [*(y for a, b in zip(cuts6[::2], cuts6[1::2], strict=True) for y in (a - 1, a, b - 1, b)), *(rng.randrange(2**125, 2**127) for _ in range(200))]]
    where = lambda n, ranges: next((c for a, b, c in ranges if a is not None and a <= n <= b), None)
    six_n = [(int(ipaddress.IPv6Address(a)), int(ipaddress.IPv6Address(b)), c) for a, b, c in six[:-2]]
    want = {str(x): where(int(x), four) for x in asked} | {str(x): where(int(x), six_n) for x in asked6} | {"no address": None}
    df = spark.createDataFrame([(x, 1) for x in [*want, None, None]], "ip string, code int")
    got = gates.locate(df, "ip", spark.createDataFrame(four, "first long, last long, code string"), "country", spark.createDataFrame(six, "first string, last string, code string"))
    assert got.columns == ["ip", "code", "country"]
    rows = got.collect()
    assert {r.ip: r.country for r in rows if r.ip is not None} == want
    assert sum(r.ip is None for r in rows) == 2 and any(want.values())


def test_whole_spaces_and_no_ranges(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("2001:db8::1",), (None,)], "ip string")
    whole = gates.locate(df, "ip", spark.createDataFrame([(0, 2**32 - 1, "A")], "first long, last long, code string"), "c", spark.createDataFrame([("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "B")], "first string, last string, code string"))
    assert {(r.ip, r.c) for r in whole.collect()} == {("1.2.3.4", "A"), ("2001:db8::1", "B"), (None, None)}
    none = gates.locate(df, "ip", spark.createDataFrame([], "first long, last long, code string"))
    assert {(r.ip, r.country) for r in none.collect()} == {("1.2.3.4", None), ("2001:db8::1", None), (None, None)}
    wide = gates.covers(spark.createDataFrame([("2000::", "3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "X")], "first string, last string, code string"), 6)
    assert [tuple(r) for r in wide.collect()] == [(3, "001", "X")]


def test_null_addresses_are_spread(spark):
    rows = spark.range(5000).select(F.lit(None).cast("string").alias("ip"), "id")
    got = ip_in_any(rows, "ip", spark.createDataFrame([("10.0.0.0/8",)], "cidr string"), "on")
    assert got.where("on").count() == 0 and got.count() == 5000
