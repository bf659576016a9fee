"""Parsers go through a long line once."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import parse, predicates


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).head().x


def test_pairs_are_found_once(spark):
    plan = spark.createDataFrame([("a=1",)], "l string").select(parse.parse_key_value(F.col("l")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1
    got = one(spark, 'x, a=1,b="q \\" é=3" a=9\tc= _d.e-f="" g="open h=2', parse.parse_key_value)
    assert got == {"a": "1", "b": 'q \\" é=3', "c": "", "_d.e-f": "", "g": "", "h": "2"}


@pytest.mark.parametrize(("tail", "want"), [
    (', request: "a"', ("a", "m")), (', request: "é\\" b, client: x"', ('é\\" b, client: x', "m")), (', request: ""', (None, "m")),
    (', request: "a"\\"', (None, 'm, request: "a"\\"')), (', request: "a"\\\\', (None, 'm, request: "a"\\\\')), (', cequest: "a"', (None, 'm, cequest: "a"')),
])
def test_nginx_ends(spark, tail, want):
    """A quoted value ends with the quote that closes it, not with an escape behind it."""
    r = one(spark, f"2024/01/01 00:00:00 [error] 7#0: *3 m{tail}", parse.parse_nginx_error)
    assert (r.request, r.message) == want


@pytest.mark.parametrize("extra", ["", "\x1f", "\x1e\x1f", "\x1e\x1f\x01\x02"])
def test_first_match_reads_the_first(spark, extra):
    """The leftmost match counts, whatever stands around it, also where it may match again at the end."""
    got = one(spark, f"{extra}no probe from 10.0.0.1 é probe from 10.0.0.2{extra}", lambda t: predicates.first_match(t, [r"(?<A>\w*) probe from %%%%SRC%%%%"]))
    assert (got.A, got.SRC) == ("no", "10.0.0.1")
    got = one(spark, f"xaab{extra}", lambda t: predicates.first_match(t, [r"(?<A>a*)"]))
    assert (got.pattern, got.A) == (0, None)
    assert one(spark, f"\x1e\x1f\x1fno line{extra}", lambda t: predicates.first_match(t, [r"(?<A>x)zz(?<B>y)"])) is None
