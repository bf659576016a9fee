"""The registered queries: those with SQL against DuckDB, the pipeline against its stages done by hand."""

import hashlib
import struct

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_operators import components, coverage_by_hand, fingerprint5

from tidewatch.llm import bpe, decontaminate, secret_scan
from tidewatch.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def replaced(text, spans):
    out, at = "", 0
    for x in spans:
        if x.s >= at:
            out += text[at : x.s] + "[SECRET]"
        at = max(at, x.e)
    return out + text[at:]


def test_pipeline_by_hand(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {i: fingerprint5(r.text) for i, r in docs.items()}  # every document has a language here
    ids = sorted(fp)
    near = [(ids[j], i) for k, i in enumerate(ids) for j in range(k) if (fp[i] ^ fp[ids[j]]).bit_count() <= 25]
    left = {i for i, c in components(ids, near).items() if i == c}
    words = lambda t: decontaminate.WORD.findall(t.lower())
    for item in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(item.text)
        seeds = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i in list(left):
            t = words(docs[i].text)
            if any(tuple(t[k : k + 5]) in seeds for k in range(len(t) - 4)) and coverage_by_hand(w, t) >= 0.8 * len(w):
                left.remove(i)
    kept = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id in ({','.join(map(str, left))})")
    spans = {r.doc_id: r.secrets for r in secret_scan.scan(kept, secret_scan.limits(kept)).collect()}
    ranks = dict(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i in left:
        text = replaced(docs[i].text, spans[i])
        coded = own.encode_ordinary(text)
        want[i] = (len(coded), hashlib.sha256(struct.pack(f"<{len(coded)}I", *coded)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    rows = corpus_pipeline.run(spark, sf).collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    assert all(hashlib.sha256(struct.pack(f"<{r.n_tokens}I", *r.token_ids)).hexdigest() == r.ids_sha256 for r in rows)
    assert len(left) < len(docs) - 5
    assert got == want


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf)
        assert out.columns == docs.columns, name
        assert out.count() == 0
