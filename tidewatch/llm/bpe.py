"""Byte-level BPE by recursive queries: encode whole texts and decode the ids again.

In every task the distinct pre-token words are rows of token lists in an in-process DuckDB. A recursive
query unnests them to token-position rows, joins the merge table, and contracts in each word the
leftmost pair of least rank until no pair is left. Decoding takes each id's token bytes, in
order, as one Arrow array. Spark partitions the documents; a task holds one slice of texts, and
a bounded cache of words that its worker has seen.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes
from .pieces import Remembered, mapped, offsets_of, piece_starts, slices

#: New pieces after which one worker forgets those it did not meet again.
CACHE_WORDS = 240_000
#: Bytes of text that are encoded and decoded together.
SLICE_BYTES = 4_000_000
#: Words of more bytes are contracted by LONG_SQL.
LONG_WORD = 400

ENCODE_SQL = """
with recursive word(w, toks, live) as (
  select w, toks, true from fresh
  union all
  (with pos as (
     select w, unnest(toks) as t, unnest(toks[2:]) as nt, generate_subscripts(toks, 1) as p
     from word where live),
   best as (
     select w, min((m.c::bigint << 32) | p) as bk
     from pos join merges m on m.ab = ((t::bigint << 32) | nt) group by w)
   select word.w,
          case when bk is null then toks
               else toks[:(bk & 4294967295) - 1] || [(bk >> 32)::integer] || toks[(bk & 4294967295) + 2:] end,
          bk is not null
   from word left join best using (w) where word.live)
)
select w, toks from word where not live order by w
"""

#: The same for long words. A word's latest state alone is held. All places of the least rank that don't overlap are
#: contracted at once, from the left, if no pair that this makes has a lower rank, so that the order can't matter.
LONG_SQL = """
with recursive word(w, toks, live) using key (w) as (
  select w, toks, true from fresh
  union
  (with pos as (
     select w, unnest(toks) as t, unnest(toks[2:]) as nt, unnest([-1] || toks[:len(toks) - 1]) as before, unnest(toks[3:]) as after,
            generate_subscripts(toks, 1) as p
     from word where live),
   pair as (select w, p, c, before, after from pos join merges m on m.ab = ((t::bigint << 32) | nt)),
   best as (select w, min((c::bigint << 32) | p) as bk from pair group by w),
   alike as (
     select w, p, c, before, after, p - row_number() over (partition by w order by p) as run
     from pair join best using (w) where c = bk >> 32),
   around as (
     select w, c, unnest([before::bigint * 4294967296 + c, c::bigint * 4294967296 + coalesce(after, -1), c::bigint * 4294967296 + c]) as ab
     from alike),
   lower as (select distinct w from around join merges m using (ab) where m.c < around.c),
   chosen as (
     select w, p, c from (select *, row_number() over (partition by w, run order by p) as k from alike)
     where k % 2 = 1 and w not in (select w from lower)),
   several as (select w from chosen group by w having count(*) > 1),
   marked as (
     select pos.w, pos.p, coalesce(c, t) as t, lag(c) over (partition by pos.w order by pos.p) is null as stays
     from pos join several using (w) left join chosen on pos.w = chosen.w and pos.p = chosen.p),
   made as (select w, list(t order by p) as new from marked where stays group by w)
   select w,
          case when new is not null then new
               when bk is null then toks
               else toks[:(bk & 4294967295) - 1] || [(bk >> 32)::integer] || toks[(bk & 4294967295) + 2:] end,
          bk is not null
   from word left join best using (w) left join made using (w) where live)
)
select w, toks from word order by w
"""

def load_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


class Coder:
    """Encoder and decoder of one worker process."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        import duckdb
        import regex

        self.rank = dict(ranks)
        self.find = regex.compile(pattern).findall
        self.byte_id = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        left, right, made = [], [], []
        for token, r in ranks:
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(r)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": os.path.join(tempfile.gettempdir(), f"merges-{os.getpid()}")})
        pairs = pa.table({"ab": (np.array(left, np.int64) << 32) | np.array(right, np.int64), "c": np.array(made, np.int32)})  # noqa: F841
        self.db.execute("create table merges as select * from pairs")
        token = {r: t for t, r in ranks}
        #: the bytes of each id, null where there is no such id
        self.vocab = pa.array([token.get(r) for r in range(1 + max(token))], pa.large_binary())
        #: piece -> its ids, which are little-endian 32-bit integers
        self.known = Remembered(self.ids_of, CACHE_WORDS)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: of the vocabulary, or contracted by a recursive query."""
        out = [b""] * len(words)
        short, long = [], []
        for k, w in enumerate(words):
            if (r := self.rank.get(w)) is not None:
                out[k] = r.to_bytes(4, "little")
            else:
                (long if len(w) > LONG_WORD else short).append(k)
        for rows, query in ((short, ENCODE_SQL), (long, LONG_SQL)):
            if rows:
                for k, ids in zip(rows, self.contract([words[k] for k in rows], query), strict=True):
                    out[k] = ids
        return out

    def contract(self, fresh: list[bytes], query: str) -> list[bytes]:
        toks = pa.ListArray.from_arrays(pa.array(offsets_of(fresh), pa.int32()), pa.array(self.byte_id[np.frombuffer(b"".join(fresh), np.uint8)]))
        self.db.register("fresh", pa.table({"w": pa.array(range(len(fresh)), pa.int32()), "toks": toks}))
        done = self.db.sql(query).to_arrow_table().combine_chunks()
        self.db.unregister("fresh")
        lists = done["toks"].chunk(0)
        flat = lists.flatten().to_numpy().astype("<u4").tobytes()
        offs = ((lists.offsets.to_numpy() - lists.offsets[0].as_py()) * 4).tolist()
        return [flat[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece of text, word by word."""
        words = [[w.encode() for w in self.find(p.decode("utf-8", "replace"))] for p in pieces]
        distinct = list({w for ws in words for w in ws})
        of = dict(zip(distinct, self.merge(distinct), strict=True))
        return [b"".join([of[w] for w in ws]) for ws in words]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        data, docs = b"".join(texts), offsets_of(texts)
        return mapped(data, piece_starts(np.frombuffer(data, np.uint8), docs), docs, self.known)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each text: those of its ids, one after another."""
        spelt = self.vocab.take(pa.array(np.frombuffer(b"".join(ids), "<i4")))
        if spelt.null_count:
            raise ValueError("ids without a token")
        ends = np.frombuffer(spelt.buffers()[1], np.int64)[spelt.offset :][offsets_of(ids) // 4] if len(spelt) else np.zeros(len(ids) + 1, np.int64)
        whole = memoryview(spelt.buffers()[2]) if len(spelt) else b""
        return [bytes(whole[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_coders: dict[tuple, Coder] = {}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Encode and decode every text: (id, n_tokens, ids_sha256, decoded_sha256), with ``keep`` also token_ids array<int>.

    Null text counts as empty (no ids); repeated rows and ids give a row each; an empty table gives
    an empty result; other columns are ignored. Long texts are whole: a slice has at least one.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))  # a fixed file of about 1 MB
    key = (ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _coders:
            _coders[key] = Coder(ranks.value, pattern)
        coder = _coders[key]
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                ids = coder.encode(batch.column(1).slice(a, b - a).to_pylist())
                named = {
                    id_col: batch.column(0).slice(a, b - a), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in coder.decode(ids)], pa.string()),
                }
                if keep:
                    named["token_ids"] = pa.ListArray.from_arrays(pa.array(offsets_of(ids) // 4, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if keep else "")
    return docs.select(F.col(f"`{id_col}`"), text_bytes(text_col).alias("t")).mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
