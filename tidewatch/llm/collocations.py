"""Phrases whose words stand together more often than apart, by prefix-free parsing.

A word whose hash says so begins a chunk; a chunk also holds the next four words of its piece, so every phrase of up to five
words lies in the chunk that its first word belongs to, and in that one alone is it counted. Equal passages are cut alike,
so the chunks are a dictionary: each different chunk is kept once with its frequency, and phrases are counted
inside the dictionary, weighted.

Phrases are counted by length. A phrase is counted only where both phrases that are a word shorter are frequent: these are
looked up in a bit set of fixed size, which never misses one; what it lets through by chance is counted and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .common import table, text_bytes
from .pieces import gathered, offsets_of, slices

#: Words of a phrase, at most.
LONGEST = 5
#: One word of so many begins a chunk.
TRIGGER = 16
#: Bytes of text or chunks that are read together.
SLICE_BYTES = 8_000_000
#: Rows of the table of languages that is sent to all tasks; a larger one is joined like any other.
BROADCAST_ROWS = 10_000
#: The bit set of frequent phrases: 2 to this many bits, 16 MB.
FILTER_BITS = 27
#: Bits of a part of it that is put together by Spark.
PART_BITS = 32_768

_SPACE, _BREAK = 32, 10
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit number of each word, which must not be empty: its bytes by powers of an odd number, mixed."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offs = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1]
    data, starts, lengths = np.frombuffer(words.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs[:-1] - offs[0], np.diff(offs)
    powers = np.multiply.accumulate(np.full(lengths.max(), _STEP, np.uint64))
    h = np.add.reduceat((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, lengths)], starts)
    h = (h ^ (h >> np.uint64(32))) * _SPREAD
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of folded bytes, in which line ends part the pieces."""

    def __init__(self, data: bytes):
        flat = np.frombuffer(data, np.uint8)
        breaks = flat == _BREAK
        self.solid = (flat != _SPACE) & ~breaks
        edges = np.diff(np.concatenate([[0], self.solid.view(np.int8), [0]]).astype(np.int8))
        self.starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.lengths = ends - self.starts
        self.n = len(self.starts)
        #: the piece of each word, by the line ends before it
        self.piece = np.cumsum(breaks, dtype=np.int32)[self.starts] if self.n else np.zeros(0, np.int32)
        self.flat = flat[self.solid]
        offs = np.zeros(self.n + 1, np.int32)
        np.cumsum(self.lengths, out=offs[1:])
        coded = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(offs), pa.py_buffer(self.flat.tobytes())]).dictionary_encode()
        self.ids, self.vocab = coded.indices.to_numpy(), coded.dictionary
        self.hashes = hashes_of(self.vocab)
        self.triggers = (self.hashes % np.uint64(TRIGGER) == 0)[self.ids] if self.n else np.zeros(0, bool)
        #: does the word begin its piece?
        self.first = np.ones(self.n, bool)
        self.first[1:] = self.piece[1:] != self.piece[:-1]

    def chunks(self) -> tuple[np.ndarray, list[bytes]]:
        """Place of each chunk's first word, and the chunk: its words, and up to LONGEST - 1 of those after them."""
        if not self.n:
            return np.zeros(0, np.int64), []
        begins = np.flatnonzero(self.first | self.triggers)
        pieces = np.append(np.flatnonzero(self.first), self.n)
        piece_end = pieces[np.searchsorted(pieces, begins, "right")]
        stop = np.minimum(np.append(begins[1:], self.n) + LONGEST - 1, piece_end)
        places = np.zeros(self.n + 1, np.int64)  # the words with one space after each
        np.cumsum(self.lengths + 1, out=places[1:])
        spaced = np.full(places[-1], _SPACE, np.uint8)
        of_word = np.ones(places[-1], bool)
        of_word[places[1:] - 1] = False
        spaced[of_word] = self.flat
        whole = spaced.tobytes()
        return begins, [whole[a:b] for a, b in zip(places[begins].tolist(), (places[stop] - 1).tolist(), strict=True)]


def parse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The dictionary: (lang, chunk, f) of each different chunk of a language and how often it stands in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                words = Words((b"\n".join(texts) + b"\n").translate(_FOLD))
                begins, chunks = words.chunks()
                doc = np.searchsorted(offsets_of(texts) + np.arange(len(texts) + 1), words.starts[begins], "right") - 1
                langs = batch.column(0).slice(a, b - a).take(pa.array(doc))
                seen = pa.table({"lang": langs, "chunk": pa.array(chunks, pa.binary()), "one": pa.array(np.ones(len(chunks), np.int64))})
                seen = seen.group_by(["lang", "chunk"], use_threads=False).aggregate([("one", "sum")])
                yield from pa.table({"lang": seen["lang"], "chunk": seen["chunk"].cast(pa.string()), "n": seen["one_sum"]}).to_batches()

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, "lang string, chunk string, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("f"))


def _bucket(lang: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """The bit of a phrase from the hashes of its language and its words."""
    h = lang
    for w in hashes:
        h = (h * _STEP + w) ^ (h >> np.uint64(29))
    return ((h * _SPREAD) >> np.uint64(64 - FILTER_BITS)).astype(np.int32)


def _count(dictionary: DataFrame, k: int, shorter: object) -> DataFrame:
    """(lang, phrase, bit, f) of the phrases of ``k`` words; those of ``k`` - 1 are known by the bits of ``shorter``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shorter is None else np.frombuffer(shorter.value, np.uint8)
        for whole in gathered(batches, 1, SLICE_BYTES):
            for a, b in slices(whole.column(1), SLICE_BYTES):
                batch = whole.slice(a, b - a)
                words = Words(b"\n".join(batch.column(1).to_pylist()))
                if words.n < k:
                    continue
                langs = batch.column(0).dictionary_encode()
                of_lang = np.array([xxhash.xxh64_intdigest(x) for x in langs.dictionary.to_pylist()], np.uint64)  # may be empty texts
                row = words.piece  # a chunk has one line
                lang, weight = langs.indices.to_numpy()[row], batch.column(2).to_numpy()[row]
                # a chunk's own words end before the first one after its beginning that begins another
                begun = np.cumsum(words.triggers & ~words.first)
                at = np.flatnonzero(words.first)
                own = begun == begun[at][np.searchsorted(at, np.arange(words.n), "right") - 1]
                n = words.n - k + 1
                right = own[:n] & (row[:n] == row[k - 1 :])
                if bits is not None:
                    hashes = words.hashes[words.ids]
                    bit = _bucket(of_lang[lang[: n + 1]], [hashes[i : i + n + 1] for i in range(k - 1)])
                    frequent = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    right &= frequent[:-1] & frequent[1:]
                place = np.flatnonzero(right)
                cols = {f"w{i}": words.ids[place + i] for i in range(k)}
                seen = pa.table({"lang": lang[place], **cols, "f": weight[place]})
                seen = seen.group_by(["lang", *cols], use_threads=False).aggregate([("f", "sum")]).combine_chunks()
                ids = [seen[c].to_numpy() for c in cols]
                bit = _bucket(of_lang[seen["lang"].to_numpy()], [words.hashes[i] for i in ids])
                text = [words.vocab.take(pa.array(i)) for i in ids]
                phrase = (pc.binary_join_element_wise(*text, b" ") if k > 1 else text[0]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(seen["lang"].to_numpy())), phrase, pa.array(bit), pa.array(seen["f_sum"].to_numpy())], names=["lang", "phrase", "bit", "n"])

    rows = dictionary.select("lang", F.col("chunk").cast("binary").alias("chunk"), "f")
    return rows.mapInArrow(run, "lang string, phrase string, bit int, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.first("bit").alias("bit"))


def _bits(frequent: DataFrame) -> object:
    """The bit set of frequent phrases for all tasks: of fixed size, however many there are."""
    parts = frequent.groupBy(F.expr(f"bit div {PART_BITS}").alias("part")).agg(F.expr(f"bitmap_construct_agg(bit % {PART_BITS})").alias("bits")).collect()
    whole = bytearray(1 << (FILTER_BITS - 3))
    for r in parts:
        whole[r.part * PART_BITS // 8 : (r.part + 1) * PART_BITS // 8] = r.bits
    return frequent.sparkSession.sparkContext.broadcast(bytes(whole))


def _without_covered(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates but for those inside a longer one that stands at least ``percent`` of 100 times as often."""
    words = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    longer = candidates.withColumn("w", words).where("size(w) > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("most")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, covered: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to LONGEST words that stand at least
    ``least`` times, by score, then a, then phrase in the order of its bytes.

    Texts are folded (A-Z), split into pieces at ``.,;:!?`` and line ends, and into words at spaces and tabs. a: times the
    phrase stands inside pieces, overlaps included; n: all words; l, r: times the two parts of the cut stand for which
    floor(1000 a n / (l r)) is least, the first of equal ones; that is the score. Phrases inside a longer one that stands at
    least ``covered`` of 100 times as often are left out.

    Null text is empty; a null language is ``und``; repeated rows count each; a language without such a phrase, and an empty
    table, give no rows; other columns are ignored. Long texts are whole.
    """
    dictionary = written(parse(docs, text_col, lang_col), "chunks")
    words = written(_count(dictionary, 1, None), "phrases")
    totals = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    if totals.count() <= BROADCAST_ROWS:
        totals = F.broadcast(totals)
    levels = [words.where(F.col("f") >= least)]
    for k in range(2, LONGEST + 1):
        if levels[-1].isEmpty():
            break
        levels.append(written(_count(dictionary, k, _bits(levels[-1])).where(F.col("f") >= least), "phrases"))
    frequent = reduce(DataFrame.unionByName, levels).select("lang", "phrase", "f")
    candidates = reduce(DataFrame.unionByName, levels[1:], levels[0].limit(0)).select("lang", "phrase", F.col("f").alias("a"))
    kept = _without_covered(candidates, covered)

    cut = kept.select("*", F.explode(F.expr("sequence(1, size(split(phrase, ' ')) - 1)")).alias("k"))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, char_length(left) + 2)"))
    of = lambda side, name: frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    both = cut.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    number = lambda c: f"cast({c} as decimal(19,0))"  # noqa: E731  products are exact to 38 digits
    score = F.expr(f"cast(1000 as decimal(4,0)) * {number('a')} * {number('n')} div ({number('l')} * {number('r')})")
    scored = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "n", "x.score", "x.l", "x.r")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = Window.partitionBy("lang", "salt").orderBy(*order)  # the best of each part, so that no language is one task
    best = scored.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
g as (
  select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest(range(1, 6)) as k) where len(ws) >= k)),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 100),
inner_ as (select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, max(a) as most
  from (select lang, ws, a, m, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c)) group by all),
kept as (select c.* from c left join inner_ i using (lang, phrase) where most is null or 100 * most < 100 * a),
cuts as (select lang, phrase, a, j, array_to_string(ws[:j], ' ') as lp, array_to_string(ws[j + 1:], ' ') as rp from (select *, unnest(range(1, k)) as j from kept)),
s as (select cuts.*, l.f as l, r.f as r, n.n, ((1000::hugeint * a * n.n) // (l.f::hugeint * r.f))::bigint as score
  from cuts join f l on l.lang = cuts.lang and l.phrase = lp join f r on r.lang = cuts.lang and r.phrase = rp join n on n.lang = cuts.lang),
b as (select *, row_number() over (partition by lang, phrase order by score, j) as x from s),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b where x = 1)
select lang, rank, phrase, a, l, r, n, score from o where rank <= 2000
"""
