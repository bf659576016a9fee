"""Token files: ids of every text as Parquet list columns that can be read selectively.

Rows lie in ascending id order over all files. Ids are dictionary-encoded lists in row groups of a
set size; the writer adds page indexes, so a reader can take the counts and metadata alone, or the ids
of a range of documents, without reading the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, table, text_bytes
from .pieces import Remembered, inside, mapped, offsets_of, piece_starts, slices

#: New pieces after which one worker forgets those it did not meet again.
CACHE_PIECES = 250_000
#: Bytes of text that are encoded together.
SLICE_BYTES = 4_000_000
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: Pieces that are given to the tokenizer as one string.
JOINED = 4000


class Tokens:
    """The tokenizer of one worker, asked once for each different piece of text."""

    def __init__(self, json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_str(json)
        self.added = [t.content.encode() for t in self.of.get_added_tokens_decoder().values()]  # taken whole wherever a text has them
        self.lettered = [t for t in self.added if t.decode("utf-8", "replace").strip().isalpha()]  # those that a word can hold
        self.line = self.of.token_to_id("Ċ")  # how byte-level vocabularies write a line's end
        #: byte -> the character that byte-level vocabularies write for it
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelt = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.known = Remembered(self.ids_of, CACHE_PIECES)

    def one_by_one(self, pieces: list[bytes]) -> list[bytes]:
        found = self.of.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def joined(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of one word: the ids of their lines are cut at the ids of the lines' ends."""
        text = b"\n".join(pieces).decode("utf-8", "replace")
        ids = np.array(self.of.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != len(pieces) - 1:
            return self.one_by_one(pieces)
        data, ends = ids.tobytes(), (ends * 4).tolist()
        return [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(ids) * 4], strict=True)]

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Words of letters are the model's own unit; what else there is goes through the whole tokenizer."""
        out = [b""] * len(pieces)
        merge, spelt, pack = self.of.model.tokenize, self.spelt, struct.pack
        plain, odd = [], []
        for k, p in enumerate(pieces):
            if p.decode("utf-8", "replace").removeprefix(" ").isalpha() and not any(t in p for t in self.lettered):
                ids = [t.id for t in merge(p.decode("latin-1").translate(spelt))]
                out[k] = pack(f"<{len(ids)}I", *ids)
            else:
                (plain if p.split() == [p.removeprefix(b" ")] else odd).append(k)
        for k, x in zip(odd, self.one_by_one([pieces[k] for k in odd]), strict=True):
            out[k] = x
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            for k, x in zip(some, self.joined([pieces[k] for k in some]), strict=True):
                out[k] = x
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        data, docs = b"".join(texts), offsets_of(texts)
        return mapped(data, piece_starts(np.frombuffer(data, np.uint8), docs, inside(data, self.added)), docs, self.known)


_tokens: dict[str, Tokens] = {}


def write_tokens(docs: DataFrame, tokenizer_path: str, place: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = ()) -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending id order to ``place``.

    The file format: id, the ``meta`` columns, part (number of the file), first (ids before the
    document in its part), n_tokens, ids. Null text counts as empty and has the end id alone; null ids
    come first; rows with one id are ordered by their texts' hash; an empty table gives no rows. Names of ``meta`` that
    the format has itself are an error; columns that aren't asked for have no part.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        json = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of about 1.5 MB
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokens:
            _tokens[tokenizer_path] = Tokens(json.value)
        part, first = TaskContext.get().partitionId(), 0
        for whole in batches:
            for a, b in slices(whole.column("_text"), SLICE_BYTES):
                batch = whole.slice(a, b - a)
                got = [x + end for x in _tokens[tokenizer_path].encode(batch.column("_text").to_pylist())]
                offs = offsets_of(got) // 4
                ids = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4")))
                starts = pa.array(offs[:-1] + first, pa.int64())
                first += int(offs[-1])
                named = [(c, batch.column(c)) for c in (id_col, *meta)]
                named += [("part", pa.array(np.full(len(got), part, np.int32))), ("first", starts), ("n_tokens", pa.array(np.diff(offs), pa.int64())), ("ids", ids)]
                yield pa.RecordBatch.from_arrays([x for _, x in named], names=[n for n, _ in named])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (id_col, *meta)), "part int, first long, n_tokens long, ids array<int>"])
    own = ("part", "first", "n_tokens", "ids")
    if taken := {id_col, *meta} & {*own, "_text", "_hash"}:
        raise ValueError(f"the file format has columns of these names: {sorted(taken)}")
    texts = docs.select(*(F.col(f"`{c}`") for c in (id_col, *meta)), text_bytes(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    ordered = texts.repartitionByRange(f"`{id_col}`", "_hash").sortWithinPartitions(f"`{id_col}`", "_hash").drop("_hash")
    (
        ordered.mapInArrow(run, schema)
        .write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE)
        .option("parquet.enable.dictionary", "true").option("compression", "zstd")
        .parquet(place)
    )


def read_tokens(spark: SparkSession, place: str, id_col: str = "doc_id") -> DataFrame:
    """The files' rows with ``start``: the number of ids of all documents before. Columns that aren't asked for aren't read."""
    rows = spark.read.parquet(place)
    # Totals of the parts, and what stands before each part. Broadcast: 12 bytes for each file of the store.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select(id_col, (F.col("first") + F.col("before")).alias("start"), *(c for c in rows.columns if c not in (id_col, "part", "first")))


def with_crc32(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32): the checksum of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offs, flat = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy().astype("<u4").tobytes())
            crc = [zlib.crc32(flat[a * 4 : b * 4]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, "start", "n_tokens")), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, "start", "n_tokens", "ids").mapInArrow(run, f"{id_col} {kind}, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    place = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), place)
    return with_crc32(read_tokens(spark, place))
