"""Lines that hold the parsers' separators are read in one pass, and small tables are dealt out before long lines are parsed."""

import time

from pyspark.sql import functions as F

from tidewatch.functions import parse
from tidewatch.plans.queries import QUERIES


def test_any_separators(spark):
    """Lines with none of the separators, with the first pair, with the second, and with both, give their own fields."""
    for extra in ("", "\x1e\x1f", "\x01\x02", "\x1e\x1f\x01\x02", "\x1f\x02"):
        line = f"<13>Jan  1 00:00:00 ho{extra}st app{extra}[7]: a{extra}b{extra}"
        got = spark.createDataFrame([(line,)], "l string").select(parse.parse_bsd_syslog(F.col("l")).alias("r")).select("r.*").head()
        assert (got.hostname, got.daemon, got.pid, got.message) == (f"ho{extra}st", f"app{extra}", "7", f"a{extra}b{extra}")
        bad = spark.createDataFrame([(f"no{extra} line",)], "l string").select(parse.parse_bsd_syslog(F.col("l")).alias("r")).head()
        assert bad.r is None


def test_separators_cost_little(spark):
    """A long line that holds separators takes about the time of one that holds others."""
    took = {}
    for extra in ("\x03", "\x1e"):
        text = F.concat(F.lit(f"<13>Jan  1 00:00:00 host app[7]: {extra}"), F.repeat(F.lit("word "), 20_000), F.col("id"))
        rows = spark.range(0, 60, 1, 1).select(text.alias("l")).select(parse.parse_bsd_syslog(F.col("l"))["message"].alias("m"))
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            rows.select(F.sum(F.length("m"))).collect()
            runs.append(time.perf_counter() - began)
        took[extra] = min(runs)
    assert took["\x1e"] < 3 * took["\x03"] + 0.5, took


def test_small_tables_are_dealt_out(spark, sf_large):
    for name in ("parse_long_lines", "parse_separators"):
        assert QUERIES[name](spark, sf_large).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_nginx_values(spark):
    line = r'2024/01/01 00:00:00 [error] 7#0: *3 a \" b, client: 1.2.3.4, request: "GET /\", x, client: 6.6.6.6", host: ""'
    got = spark.createDataFrame([(line,)], "l string").select(parse.parse_nginx_error(F.col("l")).alias("r")).select("r.*").head()
    assert (got.client, got.request, got.host, got.message) == ("1.2.3.4", r"GET /\", x, client: 6.6.6.6", None, r"a \" b")
