"""Spans of regular expressions as columns. DataFrame operations only.

``regexp_extract_all`` gives the matches and ``split`` with the same pattern what stands between them;
running lengths give positions in code points, n matches in n log n steps. Patterns must match at least one character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of context that a span keeps on each side.
NEAR = 40
FOUND = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], zero: object) -> Column:
    """Running results of an associative ``combine`` over an array: the n-th joins the first n values.

    Each pass combines every place with the one twice as far before it, so n values take log2(n) passes over the array.
    """

    def further(acc: Column, k: Column) -> Column:
        gap = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(zero), gap), F.slice(acc, F.lit(1), F.size(acc) - gap)), combine)

    passes = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)
    return let(values, lambda v: F.when(F.size(v) > 1, F.aggregate(passes(v), v, further)).otherwise(v))


def positions(matches: Column, between: Column) -> Column:
    """FOUND: start, end, match and neighbouring text of each match, from matches and the pieces between them."""
    n = F.size(matches)
    lengths = F.zip_with(F.slice(between, 1, n), matches, lambda b, m: F.char_length(b) + F.char_length(m))
    rows = F.zip_with(matches, running(lengths, lambda x, y: x + y, 0), lambda m, e: F.struct(m.alias("m"), e.alias("e")))
    beside = F.zip_with(F.slice(between, 1, n), F.slice(between, 2, n), lambda b, a: F.struct(F.right(b, F.lit(NEAR)).alias("b"), F.left(a, F.lit(NEAR)).alias("a")))
    one = lambda x, y: F.struct((x["e"] - F.char_length(x["m"])).alias("s"), x["e"].alias("e"), x["m"].alias("m"), y["b"].alias("before"), y["a"].alias("after"))
    return F.when(n > 0, F.zip_with(rows, beside, one)).otherwise(F.array().cast(FOUND))


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], prefix: str = "_") -> DataFrame:
    """Add for each kind the FOUND column ``<prefix><kind>``; ``text`` must not be null."""
    # Each step is a projection of its own, and each match list is computed once.
    df = df.withColumns({f"{prefix}m_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    df = df.withColumns({f"{prefix}p_{k}": F.when(F.size(f"{prefix}m_{k}") > 0, F.split(text, p, -1)) for k, p in patterns.items()})
    df = df.withColumns({f"{prefix}{k}": positions(F.col(f"{prefix}m_{k}"), F.col(f"{prefix}p_{k}")) for k in patterns})
    return df.drop(*(f"{prefix}{x}_{k}" for k in patterns for x in "mp"))


def merged(kinds: dict[str, Column], score: Callable[[str, Column], Column]) -> Column:
    """All spans of the kinds by start, then kind as listed: array of (s, k, e, kind, score)."""

    def ranked(n: int, kind: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), score(kind, x).cast("int").alias("score"))

    parts = [F.transform(c, ranked(n, kind)) for n, (kind, c) in enumerate(kinds.items())]
    return F.array_sort(F.concat(*parts))


def spelt(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def holding(spans: Column, test: Callable[[str, Column], Column], kind: str) -> Column:
    return F.filter(spans, lambda x: test(kind, x))


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
