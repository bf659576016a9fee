"""Decoders are columns of Spark: no batch of whole texts goes to Python. They give what Python's codecs give."""

import base64
import random
import re

from pyspark.sql import functions as F

from tidewatch.functions import predicates as P
from tidewatch.plans.queries import QUERIES


def lenient(v):
    kept = re.sub(r"[^A-Za-z0-9+/]", "", v.split("=")[0])
    kept = kept[: len(kept) - (len(kept) % 4 == 1)]
    return base64.b64decode(kept + "=" * (-len(kept) % 4)).decode("utf-8", "replace")


def wide(v):
    raw = v.encode("latin-1", "ignore")
    return [t for t in (raw[: len(raw) // 2 * 2].decode(c, "ignore") for c in ("utf-16-le", "utf-16-be")) if t]


def test_no_python(spark, sf):
    plan = QUERIES["predicate_decode"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_decoders_are_those_of_python(spark):
    rng = random.Random(4)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))
    coded = [base64.b64encode(bytes(rng.choice([65, 0x80, 0xC3, 0xA9, 0xE2, 0x82, 0xED, 0xA0, 0xF0, 0x9F, 0x98, 0xF5, 10]) for _ in range(rng.randrange(12)))).decode() for _ in range(400)]
    coded += [some("QUJD+/= -_\né", 12) for _ in range(400)] + ["", "=", "A", "AB", "ABC", "a=b"]
    bytes_ = [some("ab\x00\x01\xd8\xdb\xdc\xdf\xe0\xff\n\rΔ \x85", 11) for _ in range(1200)] + ["", "a", "\xff\xfea\x00"]
    rows = spark.createDataFrame([(x,) for x in coded + bytes_] + [(None,)], "v string")
    got = {r.v: (r.b, r.w) for r in rows.select("v", P.decode_base64(F.array("v")).alias("b"), P.decode_utf16(F.array("v")).alias("w")).collect()}
    assert got.pop(None) == ([], [])
    for v, (b, w) in got.items():
        assert b == [x for x in [lenient(v)] if x], ascii(v)
        assert w == wide(v), ascii(v)
