"""Lines of files in their order, whatever tasks read them, and records of several lines over the borders of blocks."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import match
from tidewatch.sources import logs


@pytest.fixture
def split_bytes(spark):
    def set_to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(tmp_path, seed=1, n=4000):
    rnd = random.Random(seed)
    kinds = ["head é{}", "  cont {}", "\tcont {}", "", "  ", "head {}\r"]
    lines = [rnd.choices(kinds, [3, 6, 6, 1, 1, 1])[0].format(k) for k in range(n)]
    (tmp_path / "a.log").write_bytes("\n".join(lines).encode() + b"\n")
    (tmp_path / "b.log").write_bytes(b"\n" * 400)  # as many lines as bytes
    return lines


@pytest.mark.parametrize("size", [1 << 27, 5000, 64])
def test_lines_come_in_the_order_of_the_file(spark, tmp_path, split_bytes, size):
    lines = written(tmp_path)
    split_bytes(size)
    rows = logs.read_logs(spark, str(tmp_path / "*.log"))
    of = {name: [r.line for r in rows.where(F.col("source").endswith(name)).orderBy("seq").collect()] for name in ("a.log", "b.log")}
    assert of["a.log"] == [x.rstrip("\r") for x in lines]
    assert of["b.log"] == [""] * 400
    if size == 5000:
        assert rows.select("source", "seq.block").distinct().count() > 8


@pytest.mark.parametrize("size", [1 << 27, 3000])
def test_offsets_are_those_of_the_file(spark, tmp_path, split_bytes, size):
    written(tmp_path)
    split_bytes(size)
    data = (tmp_path / "a.log").read_bytes()
    got = logs.read_log_offsets(spark, str(tmp_path / "a.log")).orderBy("at").collect()
    assert [data[r["at"] : r["until"]].rstrip(b"\r\n").decode() for r in got] == [r.line for r in got]
    assert got[0]["at"] == 0 and got[-1]["until"] == len(data)
    assert all(x["until"] == y["at"] for x, y in zip(got, got[1:]))


def test_reading_goes_on_where_it_stopped(spark, tmp_path):
    for name, text in (("grown", "a\nb\n"), ("shorter", "long line\n"), ("same", "x\n")):
        (tmp_path / name).write_text(text)
    ends = logs.read_log_offsets(spark, str(tmp_path)).groupBy("source").agg(F.max("until").alias("until"))
    ends = spark.createDataFrame(ends.collect(), ends.schema)  # as of then
    (tmp_path / "grown").write_text("a\nb\nc\n")
    (tmp_path / "shorter").write_text("new\n")
    (tmp_path / "fresh").write_text("f\n")
    assert sorted(r.line for r in logs.read_logs_after(spark, str(tmp_path), ends).collect()) == ["c", "f", "new"]
    (tmp_path / "none").mkdir()
    assert logs.read_log_offsets(spark, str(tmp_path / "none")).count() == 0


def glue(lines, is_cont, most):
    records = []
    for k, line in enumerate(lines):
        if k and is_cont(line):
            records[-1].append(line)
        else:
            records.append([line])
    return sorted("\n".join(r[k : k + most]) for r in records for k in range(0, len(r), most))


@pytest.mark.parametrize("size", [1 << 27, 700, 40])
def test_records_of_several_lines_span_blocks(spark, tmp_path, split_bytes, size):
    lines = [x.rstrip("\r") for x in written(tmp_path, seed=2)]
    lines[:3] = ["  goes on from nothing", "  more", "  more"]
    lines[1000:1700] = [f"  long {k}" for k in range(700)]  # a record over many blocks
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    split_bytes(size)
    rows = logs.read_logs(spark, str(tmp_path / "a.log"))
    want = glue(lines, lambda x: x[:1].isspace(), 50)
    assert sorted(r.line for r in match.join_multiline(rows, r"^\s", block=F.col("seq.block")).collect()) == want
    assert sorted(r.line for r in match.join_multiline(rows, r"^\s").collect()) == want


def test_blocks_give_what_a_whole_source_gives(spark):
    rnd = random.Random(3)
    us, rows = 0, []
    for k in range(3000):
        us += rnd.choice([0, 1, 1, 1, 3]) * 1_000_000
        rows.append(("s" if k % 3 else "t", k, us if k % 11 else None, rnd.choice(["head", " a", " b", None])))
    df = spark.createDataFrame(rows, "source string, seq long, us long, line string")
    whole = sorted(map(tuple, match.join_multiline(df, r"^ ", 4).collect()), key=repr)
    for length in (1, 2, 7, 500):
        blocks = match.join_multiline(df, r"^ ", 4, block=F.floor(F.col("seq") / length))
        assert sorted(map(tuple, blocks.collect()), key=repr) == whole
