"""Offenses that wait for a capture, however many of one key: all are completed, and those that are too old leave the state."""

import json

from pyspark.sql import functions as F
from test_log_streaming import N, played, tail
from test_stream_blocks import Handle

from tidewatch.operators import state
from tidewatch.operators.common import SECOND
from tidewatch.streaming import jobs


def test_all_that_wait_are_completed(spark, tmp_path):
    """One key's offenses of several micro-batches wait for one capture near the end."""
    data = [("k", (10 * o + 10) * SECOND, o, o == N - 20, f"v{o}") for o in range(N)]
    df = spark.createDataFrame(data, "key string, us long, ord long, capture boolean, value string")
    o = df.where("not capture").withColumn("id", F.col("ord")).drop("value", "capture")
    c = df.where("capture").withColumnRenamed("value", "src").drop("capture")
    for name, limit, n in (("all", {}, 199), ("some", {"most": 100}, 100)):
        got = played(spark, tmp_path / name, df, lambda s: jobs.stream_correlate(s, ["value"], 5, 2000, **limit), df.schema, tail(spark, df))  # noqa: B023
        later = state.correlate_deferred(o, c, ["src"], 2000, **limit).collect()
        assert sorted((g[1], g[2], g[4]) for g in got) == sorted((r.id, r.at_us, r.src) for r in later)
        assert len(got) == n
        spark.catalog.dropTempView("out")


def test_what_waits_is_bounded_by_time():
    """Of a key that never has a capture only the offenses of the last ``defer`` seconds are held; a capture then completes them
    without all being read at once."""
    handle, fold, held = Handle(), jobs.Capture(["value"], 10, 600), None
    fold.open(handle, "k0 string")
    for turn in range(40):
        fold.load(("k",), json.loads(json.dumps(held)))
        for n in range(turn * 500, turn * 500 + 500):
            assert not list(fold.step((n * SECOND, n, False, None)))
        held = fold.save()
        assert len(fold.waits) <= 600 and len(handle.table) <= 5
    fold.load(("k",), json.loads(json.dumps(held)))
    done, most = [], 0
    for row in fold.step((20_000 * SECOND, 20_000, True, "x")):
        done.append(row)
        most = max(most, len(fold.waits.new))
    assert done == [(n, 20_000 * SECOND, 20_000, "x") for n in range(19_401, 20_000)]
    assert most <= jobs.ROW
    fold.save()
    assert not handle.table
