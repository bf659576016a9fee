"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Documents that share five-word seeds with a benchmark item are tiled: the longest common runs of
words that no tile covers yet are marked again and again, with shorter and shorter search lengths,
down to the seed length. The share of the item's words under tiles is its coverage, whatever the order
of the passages in the document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words of a seed, and of the shortest tile.
SEED_WORDS = 5
COVERAGE = 0.8
#: Characters of benchmark text that are held by each task; a larger benchmark is matched block by block.
BLOCK_CHARS = 32 << 20

WORD = re.compile(r"\w+")
#: Base of the hashes, odd, so that it has an inverse among numbers of 64 bits.
_BASE = 0x9E3779B97F4A7C15
#: Pairs of equal windows that are looked at together.
PAIRS = 1_000_000


class Rolling:
    """Karp-Rabin hashes of all runs of tokens, of any length, from one pass of running sums."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        if len(Rolling._up) < n + 1:
            size = np.full(2 * n + 1, _BASE, np.uint64), np.full(2 * n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
            for x in size:
                x[0] = 1
            Rolling._up, Rolling._down = (np.multiply.accumulate(x) for x in size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((tokens.astype(np.uint64) + np.uint64(1)) * Rolling._down[:n], out=self.sums[1:])

    def at(self, i: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hashes of the runs of n tokens from each i."""
        return (self.sums[i + n] - self.sums[i]) * Rolling._up[i]


def windows(tokens: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n tokens (tokens from 0; runs with a negative one hash to 0)."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    odd = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(tokens < 0, out=odd[1:])
    return np.where(odd[n:] == odd[:-n], Rolling(tokens).at(np.arange(len(tokens) - n + 1), n) | np.uint64(1), np.uint64(0))


def _until_taken(free: np.ndarray) -> np.ndarray:
    """How many free tokens there are from each place on."""
    taken = np.append(np.flatnonzero(~free), len(free))
    return taken[np.searchsorted(taken, np.arange(len(free)))] - np.arange(len(free))


def _matches(item: np.ndarray, text: np.ndarray, hashes: tuple[Rolling, Rolling], free: tuple[np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, ...]:
    """(i, j, n) of the longest common runs of free tokens, of ``least`` or more, that begin nowhere earlier."""
    left, right = (_until_taken(f) for f in free)
    wi, wj = np.flatnonzero(left >= least), np.flatnonzero(right >= least)
    hi, hj = hashes[0].at(wi, least), hashes[1].at(wj, least)
    order = np.argsort(hi, kind="stable")
    wi, hi = wi[order], hi[order]
    lo, up = np.searchsorted(hi, hj, "left"), np.searchsorted(hi, hj, "right")
    some = up > lo
    wj, lo, times = wj[some], lo[some], (up - lo)[some]
    cuts = np.searchsorted(np.cumsum(times), np.arange(0, times.sum(), PAIRS), "right").tolist()
    found = []
    for a, b in zip(cuts, [*cuts, len(times)][1:], strict=True):
        t = times[a:b]
        j = np.repeat(wj[a:b], t)
        i = wi[np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(lo[a:b], t)]
        inside = (i > 0) & (j > 0) & (item[i - 1] == text[j - 1]) & free[0][i - 1] & free[1][j - 1]  # of a longer one
        found.append((i[~inside], j[~inside]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    short, long = np.full(len(i), least), np.minimum(left[i], right[j])
    while (short < long).any():  # all lengths by bisection, comparing hashes
        middle = (short + long + 1) // 2
        same = hashes[0].at(i, middle) == hashes[1].at(j, middle)
        short, long = np.where(same, middle, short), np.where(same, long, middle - 1)
    return i, j, short


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of greedy tiles, longest first, the leftmost of equal ones. Negative tokens match nothing."""
    hashes, free = (Rolling(item), Rolling(text)), (item >= 0, text >= 0)
    tiles: list[tuple[int, int, int]] = []
    search = max(least, min(len(item), len(text)))
    while search >= least:
        i, j, n = _matches(item, text, hashes, free, search)
        longest, before = int(n.max(initial=0)), len(tiles)
        best = np.flatnonzero(n == longest)
        for a, b in zip(*(x[best][np.lexsort((j[best], i[best]))].tolist() for x in (i, j)), strict=True):
            mine, other = slice(a, a + longest), slice(b, b + longest)
            if free[0][mine].all() and free[1][other].all() and np.array_equal(item[mine], text[other]):
                tiles.append((a, b, longest))
                free[0][mine] = free[1][other] = False
        if len(tiles) > before:
            search = min(search, longest)
        else:
            search = search // 2 if search > 2 * least else search - 1
    return tiles


class Benchmark:
    """Seeds of benchmark items. Items of fewer than SEED_WORDS words have none and never match."""

    def __init__(self, items: list[tuple[int, str]]):
        self.word: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        hashes, owners = [], []
        for item_id, text in items:
            tokens = np.array([self.word.setdefault(w, len(self.word)) for w in WORD.findall((text or "").lower())], np.int64)
            h = np.unique(windows(tokens, SEED_WORDS))
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            self.items.append((item_id, tokens))
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.seed, self.owner = flat[order], np.concatenate([*owners, np.zeros(0, np.int64)]).astype(np.int64)[order]

    def covered(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item id, coverage, tiles, longest tile) of each item with a tile in the text."""
        tokens = np.fromiter(map(self.word.get, WORD.findall(text.lower()), repeat(-1)), np.int64)
        h = windows(tokens, SEED_WORDS)
        at = np.flatnonzero(h)
        lo = np.searchsorted(self.seed, h[at], "left")
        hi = np.searchsorted(self.seed, h[at], "right")
        some = hi > lo
        if not some.any():
            return []
        by_item: dict[int, list[int]] = defaultdict(list)
        for j, a, b in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
            for k in self.owner[a:b].tolist():
                by_item[k].append(j)
        out = []
        for k, places in sorted(by_item.items()):
            item_id, item = self.items[k]
            # tiles are made of seeds: keep the words under them, apart from each other
            under = np.unique(np.concatenate([np.arange(j, j + SEED_WORDS) for j in places]))
            gaps = np.flatnonzero(np.diff(under) > 1) + 1
            tiles = tile(item, np.insert(tokens[under], gaps, -1))
            if tiles:
                out.append((item_id, sum(n for _, _, n in tiles) / len(item), len(tiles), max(n for _, _, n in tiles)))
        return out


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about ``most`` characters: one for a benchmark of usual size."""
    size = benchmark.select(F.sum(F.char_length("text"))).head()[0] or 0
    n = 1 + size // most
    for k in range(n):
        some = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in some.select("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of each pair whose coverage is ``coverage`` or more.

    Null and empty texts match nothing, on either side; repeated rows report each; empty tables give no
    rows; other columns are ignored.
    """
    sc, out = docs.sparkSession.sparkContext, None
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest int"
    for block in blocks(benchmark):
        held = sc.broadcast(Benchmark(block))  # BLOCK_CHARS of text at most

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in held.value.covered(t or "") if x[1] >= coverage]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "coverage", "n_tiles", "longest"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is covered; cases as in matches()."""
    sc = docs.sparkSession.sparkContext
    for block in blocks(benchmark):
        held = sc.broadcast(Benchmark(block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not any(x[1] >= coverage for x in held.value.covered(t or "")) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
