"""SimHash near-duplicates by an exact tiled comparison of fingerprints.

Texts become fingerprints over word shingles. Different fingerprints are dealt into tiles by the population counts of
their two halves; the difference of two population counts never exceeds the number of differing bits, so only tiles
whose counts differ by the radius at most are paired. Large tiles are split into chunks of bounded size, and every
pair of chunks is a task's work: numpy exclusive-or and bit counts, again skipping parts whose counts differ too much, and
of the wide radius those pairs of which every part differs in more bits than its share of the radius.
A pair of chunks reports the forest of its links, not all of them, and components are joined up in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, cut, table, text_bytes

SEED = 42
#: Fingerprints of a chunk: a pair of chunks is compared in one task. The more fingerprints, the larger the chunks,
#: within these bounds, so that few have work for all cores and many aren't copied into many pairs.
CHUNK = (16_384, 131_072)
#: Hashes whose bits are counted together.
BLOCK = 500_000
#: Fingerprints of each side that are compared at once.
ROWS, COLS = 64, 2048
#: As many pairs of fingerprints take about as long as beginning with another value of a part.
GROUP_PAIRS = 8192


@dataclass(frozen=True)
class Kind:
    """Fingerprints of ``words``-word shingles with 64 bits in each of ``lanes`` (1: XXH64, 2: XXH3 of 128 bits), which
    link at ``radius`` differing bits or fewer. ``width`` of a tile, in population counts of a half."""

    words: int
    lanes: int
    radius: int
    width: int


#: Of the registered query: three words, 3 of 64 bits.
EXACT3 = Kind(3, 1, 3, 2)
#: Of the corpus pipeline: five words, 0.8 and more of 128 bits alike. Chance pairs are 1 in 10^11.
SIMILAR5 = Kind(5, 2, 25, 13)


def text_hashes(raw: bytes, kind: Kind) -> np.ndarray:
    """Hashes of every shingle, a row for each lane; words are runs of what isn't ASCII white space, A-Z in lower case."""
    from xxhash import xxh3_128_digest, xxh64_intdigest

    words, n = raw.lower().split(), kind.words
    whole = b" ".join(words)
    if len(words) <= n:
        cuts = [(0, len(whole))] if words else []
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        cuts = zip([0, *ends[: len(words) - n].tolist()], (ends[n - 1 :] - 1).tolist(), strict=True)
    if kind.lanes == 1:
        return np.array([xxh64_intdigest(whole[a:b], SEED) for a, b in cuts], np.uint64)[None, :]
    return np.frombuffer(b"".join([xxh3_128_digest(whole[a:b], SEED) for a, b in cuts]), ">u8").astype(np.uint64).reshape(-1, 2).T


def fingerprints_of(texts: list[bytes], kind: Kind = EXACT3) -> np.ndarray:
    """texts x lanes."""
    out = np.zeros((len(texts), kind.lanes), np.uint64)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def settle() -> None:
        flat = np.concatenate(held, axis=1)
        sizes = np.array([x.shape[1] for x in held])
        starts = np.cumsum(sizes) - sizes
        for lane in range(kind.lanes):
            for bit in range(64):
                ones = np.add.reduceat((flat[lane] >> np.uint64(bit)) & np.uint64(1), starts)
                out[rows, lane] |= (2 * ones > sizes).astype(np.uint64) << np.uint64(bit)
        held.clear()
        rows.clear()

    size = 0
    for k, raw in enumerate(texts):
        hashes = text_hashes(raw, kind)
        if hashes.shape[1]:
            held.append(hashes)
            rows.append(k)
            size += hashes.shape[1]
        if size >= BLOCK:
            settle()
            size = 0
    if held:
        settle()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: Kind = EXACT3) -> DataFrame:
    """(id, h, f0, ...): h is a hash of the text, f0 and on the fingerprint as signed 64-bit integers; null and empty texts have 0."""
    lanes = [f"f{k}" for k in range(kind.lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(2).to_pylist(), kind).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(kind.lanes))], names=["id", "h", *lanes])

    of = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_col).alias("h"), text_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, ", ".join([f"id {of}, h long", *(f"{x} long" for x in lanes)]))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each index's component; ``links`` come in blocks of index pairs."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            if not (differ := a != b).any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def near(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into left, right: 64-bit fingerprints) at most ``radius`` bits apart, part by part."""

    def parts(fp: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        counts = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4))
        kinds, of = np.unique(counts, axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        return kinds.astype(np.int16), np.split(order, np.cumsum(np.bincount(of.ravel()))[:-1])

    lk, lp = parts(left)
    rk, rp = (lk, lp) if same else parts(right)
    for x, mine in enumerate(lp):
        close = np.flatnonzero(np.abs(rk - lk[x]).sum(axis=1) <= radius)
        if same:
            close = close[close >= x]
        if not len(close):
            continue
        others = np.concatenate([rp[y] for y in close])
        for at in range(0, len(mine), step := max(1, 131_072 // len(others))):
            some = mine[at : at + step]
            hits = np.flatnonzero(np.bitwise_count(left[some, None] ^ right[None, others]).ravel() <= radius)
            yield some[hits // len(others)], others[hits % len(others)]


def near_lanes(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for fingerprints of two lanes, in blocks: one lane of a pair differs in half of the radius at most."""
    counts = [np.bitwise_count(x).sum(axis=1).astype(np.int16) for x in (left, right)]
    order = [np.argsort(c, kind="stable") for c in counts]
    counts = [c[o] for c, o in zip(counts, order, strict=True)]
    sorted_ = [np.ascontiguousarray(x[o].T) for x, o in zip((left, right), order, strict=True)]
    xor, bits = np.empty(ROWS * COLS, np.uint64), np.empty(ROWS * COLS, np.uint8)
    for x in range(0, len(left), ROWS):
        n = min(ROWS, len(left) - x)
        # right fingerprints whose counts are near enough to this block's
        first = int(np.searchsorted(counts[1], counts[0][x] - radius, "left"))
        last = int(np.searchsorted(counts[1], counts[0][x + n - 1] + radius, "right"))
        for y in range(max(first, x if same else 0), last, COLS):
            m = min(COLS, last - y)
            for lane in range(2):
                some, many = xor[: n * m], bits[: n * m]
                np.bitwise_xor(sorted_[0][lane, x : x + n, None], sorted_[1][lane, None, y : y + m], out=some.reshape(n, m))
                np.bitwise_count(some, out=many)
                at = np.flatnonzero(many <= radius // 2)
                if len(at):
                    i, j = x + at // m, y + at % m
                    other = np.bitwise_count(sorted_[0][1 - lane, i] ^ sorted_[1][1 - lane, j])
                    keep = other + many[at] <= radius
                    yield order[0][i[keep]], order[1][j[keep]]


def near_parts(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What ``near_lanes`` finds, some pairs more than once. Of radius // 2 + 1 parts of the bits one differs in a bit at most, so that
    only fingerprints are compared of which a part is alike but for a bit: a sixth of all pairs, where bits are even. Where that
    takes as long as comparing all, as with few or very similar ones, all are."""
    n = radius // 2 + 1
    if n < 8:  # parts of more than 16 bits
        yield from near_lanes(left, right, same, radius)
        return
    ends = [128 * k // n for k in range(n + 1)]

    def part(fp: np.ndarray, a: int, b: int) -> np.ndarray:
        # bits a to b, of the first lane and, where they go on, the second
        low = fp[:, 0] >> np.uint64(a) if a < 64 else fp[:, 1] >> np.uint64(a - 64)
        if a < 64 < b:
            low = low | fp[:, 1] << np.uint64(64 - a)
        return (low & np.uint64((1 << (b - a)) - 1)).astype(np.int64)

    cells, work = [], 0
    for a, b in zip(ends, ends[1:], strict=False):
        parts = [part(x, a, b) for x in (left, right)]
        held = [np.bincount(x, minlength=1 << (b - a)) for x in parts]
        values = np.arange(1 << (b - a))
        work += int((held[0] * (held[1] + sum(held[1][values ^ (1 << k)] for k in range(b - a)))).sum())
        work += GROUP_PAIRS * np.count_nonzero(held[0])
        cells.append((b - a, parts, held))
    if 2 * work > len(left) * len(right):
        yield from near_lanes(left, right, same, radius)
        return
    xor, bits, more = np.empty(ROWS * COLS, np.uint64), np.empty(ROWS * COLS, np.uint8), np.empty(ROWS * COLS, np.uint8)
    for width, parts, held in cells:
        order = [np.argsort(x, kind="stable") for x in parts]
        lanes = [np.ascontiguousarray(x[o].T) for x, o in zip((left, right), order, strict=True)]
        starts = [np.concatenate([[0], np.cumsum(x)]).tolist() for x in held]
        for v in np.flatnonzero(held[0]).tolist():
            close = [w for w in (v, *(v ^ (1 << k) for k in range(width))) if held[1][w] and not (same and w < v)]
            if not close:
                continue
            runs = [slice(starts[1][w], starts[1][w + 1]) for w in close]
            others = np.concatenate([lanes[1][:, r] for r in runs], axis=1)
            names = np.concatenate([order[1][r] for r in runs])
            for x in range(starts[0][v], starts[0][v + 1], ROWS):
                mine = slice(x, min(x + ROWS, starts[0][v + 1]))
                rows = mine.stop - x
                for y in range(0, len(names), COLS):
                    m = min(COLS, len(names) - y)
                    some, count, rest = xor[: rows * m], bits[: rows * m], more[: rows * m]
                    for lane, out in ((0, count), (1, rest)):
                        np.bitwise_xor(lanes[0][lane, mine, None], others[lane, None, y : y + m], out=some.reshape(rows, m))
                        np.bitwise_count(some, out=out)
                    np.add(count, rest, out=count)
                    at = np.flatnonzero(count <= radius)
                    if len(at):
                        yield order[0][x + at // m], names[y + at % m]


def _halves(kind: Kind) -> tuple[Column, Column]:
    half = lambda x: (F.bit_count(x) / kind.width).cast("int")
    if kind.lanes == 2:
        return half(F.col("f0")), half(F.col("f1"))
    return half(F.shiftrightunsigned("f0", 32)), half(F.col("f0").bitwiseAND(F.lit(0xFFFFFFFF)))


def links(fps: DataFrame, kind: Kind = EXACT3, chunk: int | None = None) -> DataFrame:
    """Links between different fingerprints (num, f0, ...): (a, b) of their numbers, a forest for each pair of chunks."""
    lanes = [f"f{k}" for k in range(kind.lanes)]
    hi, lo = _halves(kind)
    tiled = fps.select("num", *lanes, hi.alias("hi"), lo.alias("lo"))
    if chunk is None:
        chunk = max(CHUNK[0], min(CHUNK[1], fps.count() // 12))
    # at most 17 x 17 tiles; each has as many chunks as its size asks for
    tiles = cut(tiled.groupBy("hi", "lo").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")))
    reach = (kind.radius + kind.width - 1) // kind.width
    gap = lambda d: max(0, (abs(d) - 1) * kind.width + 1)  # noqa: E731  least difference of counts so many tiles apart
    steps = [(x, y) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1) if (x, y) >= (0, 0) and gap(x) + gap(y) <= kind.radius]
    numbered = tiles.select("hi", "lo", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"))
    other = numbered.toDF("hi2", "lo2", "c2")
    step = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps))).alias("s")
    pairs = (
        numbered.select("*", step)
        .withColumns({"hi2": F.col("hi") + F.col("s.x"), "lo2": F.col("lo") + F.col("s.y")})
        .join(other, ["hi2", "lo2"])
        .where("s.x <> 0 or s.y <> 0 or c <= c2")
        # the pair of chunks as one number: 5 bits for each tile coordinate, 22 for each chunk
        .withColumn("cell", F.expr("shiftleft(bigint(hi), 59) | shiftleft(bigint(lo), 54) | shiftleft(bigint(hi2), 49) | shiftleft(bigint(lo2), 44) | shiftleft(bigint(c), 22) | c2"))
    )
    itself = F.expr("hi = hi2 and lo = lo2 and c = c2")
    sides = F.when(itself, F.array(F.struct("hi", "lo", "c", F.lit(False).alias("second")))).otherwise(
        F.array(
            F.struct("hi", "lo", "c", F.lit(False).alias("second")),
            F.struct(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("c2").alias("c"), F.lit(True).alias("second")),
        )
    )
    # how often each chunk is compared, and where: (hi, lo, c) -> array of (cell, second)
    where = pairs.select("cell", F.explode(sides).alias("x")).groupBy("x.hi", "x.lo", "x.c").agg(F.collect_list(F.struct("cell", "x.second")).alias("cells"))
    dealt = (
        tiled.join(F.broadcast(tiles), ["hi", "lo"])  # at most 289 rows
        .select("num", *lanes, "hi", "lo", F.pmod(F.xxhash64(*lanes), F.col("chunks")).cast("int").alias("c"))
        .join(where, ["hi", "lo", "c"])
        .select("num", *lanes, F.explode("cells").alias("x"))
        .select("num", *lanes, F.col("x.cell").alias("cell"), F.col("x.second").alias("second"))
    )

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        """Links among the chunks of one pair: each fingerprint with the first of its component here."""
        num, second = cell["num"].to_numpy().astype(np.int64), cell["second"].to_numpy()
        bits = np.column_stack([cell[x].to_numpy().astype(np.int64) for x in lanes]).view(np.uint64)
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        same = not len(right)  # a chunk with itself
        b = left if same else right
        if kind.lanes == 1:
            found = near(bits[left, 0], bits[b, 0], same, kind.radius)
        else:
            found = near_parts(bits[left], bits[b], same, kind.radius)
        root = forest(len(num), ((left[i], b[j]) for i, j in found))
        moved = np.flatnonzero(root != np.arange(len(num)))
        return pd.DataFrame({"a": num[moved], "b": num[root[moved]]})

    return dealt.groupBy("cell").applyInPandas(compare, "a long, b long")


def grouped(made: DataFrame, kind: Kind) -> DataFrame:
    """Different fingerprints of ``made`` (id, h, f0, ...) with the least (id, h) of the documents reachable from each by links."""
    lanes = [f"f{k}" for k in range(kind.lanes)]
    least = cut(made.groupBy(*lanes).agg(F.min(F.struct("id", "h")).alias("least")).withColumn("num", F.monotonically_increasing_id()))
    roots = connected_components(links(least.select("num", *lanes), kind)).toDF("num", "root")
    # both sides of the join by root are written tables, so that a root of many fingerprints can be split
    linked = cut(least.join(roots, "num", "left").withColumn("root", F.coalesce("root", "num")))
    smallest = cut(linked.groupBy("root").agg(F.min("least").alias("first")))
    return cut(linked.join(smallest, "root").select(*lanes, "first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: Kind = EXACT3) -> DataFrame:
    """(id, fingerprint, component_id): component_id is the smallest id of the documents reachable by links.

    Equal fingerprints link, so texts without words (null, empty, white space: fingerprint 0) are one
    group. Repeated rows and ids give a row each; an empty table gives no rows; other columns are ignored.
    """
    lanes = [f"f{k}" for k in range(kind.lanes)]
    made = cut(fingerprints(docs, id_col, text_col, kind))
    digits = F.concat(*(F.lpad(F.hex(x), 16, "0") for x in lanes))
    return made.join(grouped(made, kind), lanes).select(F.col("id").alias(id_col), F.lower(digits).alias("fingerprint"), F.col("first.id").alias("component_id"))


def one_of_each(docs: DataFrame, kind: Kind = SIMILAR5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that are first in their group: those of least doc_id, and of equal ones
    of least text hash.

    Of equal ids and texts one row stays, that of least hash of all columns; rows of one id whose texts are no
    near-duplicates are judged apart. Rows without an id have no place in the order and all stay. Columns stay as they are,
    whatever their names.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.where("doc_id is not null")
    first = grouped(cut(fingerprints(named, kind=kind)), kind).select("first.id", "first.h").distinct()
    order = Window.partitionBy("id", "h").orderBy("all")
    rows = named.select(F.struct(*names).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.xxhash64(*names).alias("all"))
    kept = rows.join(first, ["id", "h"], "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1")
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
