"""Fill-in-middle: texts are cut at line ends and put together as prefix, suffix and middle.

A text is bytes in fixed blocks. Two Fenwick trees over the blocks hold how many line ends and how many code points
each has; a descent by halving steps finds the block in which a cut lies, and only that block is searched. Spark partitions
the documents; a task holds one slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes
from .pieces import slices

#: Bytes of a block.
BLOCK = 4096
#: Bytes of text that are cut together.
SLICE_BYTES = 8_000_000
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_NEWLINE = 10


def fenwick(counts: np.ndarray) -> list[int]:
    """The tree of ``counts``, from place 1: place i holds the sum of as many counts up to its own as its lowest bit says."""
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    at = np.arange(len(upto))
    return (upto - upto[at - (at & -at)]).tolist()


class Lines:
    """The units of a text, which are its lines with their ends, and where they end."""

    def __init__(self, data: bytes):
        self.flat = np.frombuffer(data, np.uint8)
        self.ends = self.flat == _NEWLINE
        self.begins = (self.flat & 0xC0) != 0x80  # bytes that begin a code point
        starts = np.arange(0, len(data), BLOCK)
        if len(data):
            self.units = fenwick(np.add.reduceat(self.ends, starts, dtype=np.int64))
            self.points = fenwick(np.add.reduceat(self.begins, starts, dtype=np.int64))
        else:
            self.units = self.points = [0]
        self.n = int(np.count_nonzero(self.ends)) + (len(data) > 0 and data[-1] != _NEWLINE)

    def cut(self, n: int) -> tuple[int, int]:
        """Bytes and code points of the first ``n`` units."""
        if n == 0:
            return 0, 0
        if n == self.n:
            return len(self.flat), int(np.count_nonzero(self.begins))
        block, points, left = 0, 0, n
        step = 1 << (len(self.units) - 1).bit_length()
        while step:
            further = block + step
            if further < len(self.units) and self.units[further] < left:
                block, left, points = further, left - self.units[further], points + self.points[further]
            step >>= 1
        at = block * BLOCK
        to = at + int(np.flatnonzero(self.ends[at : at + BLOCK])[left - 1]) + 1
        return to, points + int(np.count_nonzero(self.begins[at:to]))


def rearranged(data: bytes, h: list[int], rate: int, spm: int) -> tuple[int, str, bytes, int | None, int | None]:
    """(units, form, output, code points of the prefix, of the middle) of a text by its four numbers."""
    lines = Lines(data)
    if not data or h[2] % 100 >= rate or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return lines.n, "plain", data, None, None
    first, last = sorted(x % (lines.n + 1) for x in h[:2])
    (a, before), (b, upto) = lines.cut(first), lines.cut(last)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h[3] % 100 < spm:
        return lines.n, "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), before, upto - before
    return lines.n, "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), before, upto - before


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, output, prefix_chars, middle_chars) of every text, cut where its id and ``seed`` say.

    ``rate`` of 100 texts are rearranged, ``spm`` of 100 of these with the suffix first; the others, empty texts, and texts
    that hold a marker stay as they are (form ``plain``, no counts). Null text is empty; a null id is hashed as an empty
    one; rows of one id are cut alike as far as their lines are alike; repeated rows give a row each; an empty table gives
    no rows; other columns are ignored. Long texts are whole: a slice has at least one.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    numbers = F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                texts, hs = (batch.column(k).slice(a, b - a).to_pylist() for k in (1, 2))
                made = [rearranged(t, h, rate, spm) for t, h in zip(texts, hs, strict=True)]
                n, form, output, before, inside = zip(*made, strict=True)
                named = {
                    id_col: batch.column(0).slice(a, b - a), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()),
                    "output": pa.array(output, pa.binary()).cast(pa.string()), "prefix_chars": pa.array(before, pa.int64()), "middle_chars": pa.array(inside, pa.int64()),
                }
                yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), text_bytes(text_col).alias("t"), numbers.alias("h"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, output string, prefix_chars long, middle_chars long")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    of = lambda *places: F.concat(*(F.element_at(parts, k) for k in places))
    return F.when(form == "psm", of(2, 4, 3)).when(form == "spm", of(3, 4, 2)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as parts, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (
  select *, case when t = '' then 0 when ends_with(t, chr(10)) then len(parts) - 1 else len(parts) end as n,
         [('0x' || h[1:8])::bigint, ('0x' || h[9:16])::bigint, ('0x' || h[17:24])::bigint, ('0x' || h[25:32])::bigint] as hs from d),
c as (
  select *, least(hs[1] % (n + 1), hs[2] % (n + 1)) as a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) as b,
         t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or hs[3] % 100 >= 100 as plain from u),
p as (
  select *, case when a = n then t when a = 0 then '' else array_to_string(parts[1:a], chr(10)) || chr(10) end as prefix,
         case when b = n then t when b = 0 then '' else array_to_string(parts[1:b], chr(10)) || chr(10) end as upto from c),
s as (select *, substr(upto, length(prefix) + 1) as middle, substr(t, length(upto) + 1) as suffix from p)
select doc_id, n::bigint as n, case when plain then 'plain' when hs[4] % 100 < 50 then 'spm' else 'psm' end as form,
       case when not plain then length(prefix) end::bigint as prefix_chars, case when not plain then length(middle) end::bigint as middle_chars,
       sha256(case when plain then t when hs[4] % 100 < 50 then '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from s
"""
