"""Language identification by Bayesian evidence fusion.

Text gives likelihoods (hashed byte trigrams, fitted on a bounded sample of labelled documents). A first
pass turns them into soft language counts, from which grouped aggregation learns how far declared
markup languages and address suffixes can be trusted, and a prior for each host, smoothed towards its
domain, suffix and the corpus. The posterior of a row adds all four.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .pieces import offsets_of, slices

#: Labelled documents that the trigram model is fitted on, at most.
TRAIN_DOCS = 4000
BUCKETS = 1 << 16
#: Neighbouring trigrams tell much the same: each counts for so much of one.
TEMPER = 0.25
#: The class of texts unlike every language: trigrams drawn at random from so many.
OTHER, OTHER_TRIGRAMS, OTHER_PRIOR = "und", 20_000, 0.001
#: Share of names and foreign words in the text of any language.
FOREIGN = 0.2
#: Weight of the level above in a prior, in rows.
SMOOTH = 20.0
#: Rows whose best posterior is lower are rejected, as are those of class OTHER.
LEAST = 0.5
SLICE_BYTES = 1_000_000
#: Rejected rows that may be broadcast.
BROADCAST_ROWS = 100_000


#: Bytes of words: ASCII letters, apostrophe and space, and all of other characters.
_WORDY = np.array([b >= 128 or chr(b).isalpha() or b in (32, 39) for b in range(256)])


def buckets(data: bytes) -> np.ndarray:
    """Bucket of the trigram at each byte but the last two; BUCKETS if it holds more than letters and spaces."""
    raw = np.frombuffer(data, np.uint8)
    wordy = _WORDY[raw]
    b = raw.astype(np.uint32)
    code = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    code[~(wordy[:-2] & wordy[1:-1] & wordy[2:])] = BUCKETS
    return code


def plain(text: bytes) -> bytes:
    return b" " + b" ".join(text.lower().split()) + b" "


@dataclass
class Trigrams:
    langs: list[str]  # OTHER is the last
    logp: np.ndarray  # BUCKETS and a row of zeros x languages

    def likelihoods(self, texts: list[bytes]) -> np.ndarray:
        """Tempered log likelihood of each text under each language. A text without words is OTHER until told otherwise."""
        parts = [plain(t) for t in texts]
        out = np.zeros((len(texts), len(self.langs)))
        offs = offsets_of(parts)
        data = b"".join(parts)
        if len(data) < 3:
            out[:, -1] = -np.log(OTHER_PRIOR)
            return out
        codes = buckets(data)
        # of each text: its own trigrams, without the two that reach into the next
        sums = np.zeros((len(codes) + 1, len(self.langs)))
        np.cumsum(self.logp[codes], axis=0, out=sums[1:])
        ends = np.maximum(np.minimum(offs[1:] - 2, len(codes)), offs[:-1])
        out = TEMPER * (sums[ends] - sums[np.minimum(offs[:-1], len(codes))])
        out[out[:, -1] == 0, -1] = -np.log(OTHER_PRIOR)
        return out


def fit(labelled: DataFrame, most: int = TRAIN_DOCS) -> Trigrams:
    """``labelled``: (doc_id, text, lang); of more than ``most`` rows, those of least hash of the id."""
    some = labelled.where("lang is not null and text is not null").select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = labelled.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi").where("lang is not null").select("lang", F.col("text").cast("binary").alias("t"))  # ``most`` ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = plain(text or b"")
                if len(data) > 2:
                    seen.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    seen[lang] += np.bincount(buckets(data), minlength=BUCKETS + 1)
        for lang, n in seen.items():
            at = np.flatnonzero(n[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    got = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    logp = np.full((BUCKETS + 1, len(langs) + 1), -np.log(OTHER_TRIGRAMS))
    for k, lang in enumerate(langs):
        mine = got[got["lang"] == lang]
        share = np.zeros(BUCKETS + 1)
        share[mine["bucket"].to_numpy()] = mine["n"].to_numpy() / max(1, mine["n"].sum())
        logp[:, k] = np.log((1 - FOREIGN) * share + FOREIGN / OTHER_TRIGRAMS)
    logp[BUCKETS] = 0
    return Trigrams([*langs, OTHER], logp)


def declared_in(markup: Column) -> Column:
    """Primary subtag of the language that the markup declares, or null: of the first ``<html`` tag that names one. Each tag
    is read once, however long it is."""
    tags = F.regexp_extract_all(markup, F.lit(r"(?i)<html\b([^>]*+)"), F.lit(1))
    named = F.transform(tags, lambda t: F.lower(F.regexp_extract(t, r"""(?i)\slang\s*+=\s*+["']?([a-z]{2,3})\b""", 1)))
    return F.try_element_at(F.filter(named, lambda x: x != ""), F.lit(1))


def visible(markup: Column) -> Column:
    """What a reader sees. A script or style that isn't closed goes on to the end; no tag holds another's beginning, so
    every character is read a fixed number of times."""
    return F.regexp_replace(markup, r"(?is)<(script|style)\b[^<>]*+>.*?(?:</\1\b[^<>]*+>|\z)|<[^<>]*+>|&#?[a-z0-9]{1,9};", " ")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def domain_of(host: Column) -> Column:
    """The last two labels of a host name, or an empty text."""
    two = F.substring_index(host, ".", -2)
    return F.when((F.instr(two, ".") > 1) & ~F.endswith(two, F.lit(".")), two).otherwise("")


def source_of(docs: DataFrame) -> Column:
    """The source, empty where there is none."""
    return F.coalesce(F.col("source"), F.lit("")) if "source" in docs.columns else F.lit("")


def from_documents(docs: DataFrame) -> DataFrame:
    """Rows of evidence: the source stands for the host; null texts and sources, or no such column, count as empty."""
    text, source = F.coalesce(F.col("text"), F.lit("")), source_of(docs)
    return docs.select(
        F.col("doc_id"), F.lit(None).cast("long").alias("page_id"), text.cast("binary").alias("t"), F.xxhash64("text").alias("h"),
        declared_in(text).alias("declared"), source.alias("host"), source.alias("domain"), F.lit("").alias("suffix"),
    )


def from_pages(pages: DataFrame) -> DataFrame:
    html, host = F.coalesce(F.col("html"), F.lit("")), F.coalesce(host_of(F.col("url")), F.lit(""))
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id"), visible(html).cast("binary").alias("t"), F.xxhash64("html").alias("h"),
        declared_in(html).alias("declared"), host.alias("host"), domain_of(host).alias("domain"), F.regexp_extract(host, r"\.([a-z]{2})$", 1).alias("suffix"),
    )


def identify(rows: DataFrame, model: Trigrams) -> DataFrame:
    """(doc_id, page_id, h, host, declared, lang, confidence, kept) of rows of evidence.

    Rows without text are decided by the other evidence, and rejected if that doesn't suffice; without any
    evidence the most common language is not enough. Repeated rows are decided each; an empty table gives
    no rows; ties go to the first language in alphabetical order. A model of no labelled rows knows no language,
    and rejects every row.
    """
    if len(model.langs) == 1:
        none = rows.select("doc_id", "page_id", "h", "host", "declared")
        return none.withColumns({"lang": F.lit(OTHER), "confidence": F.lit(1.0), "kept": F.lit(False)})
    names = [f"l{k}" for k in range(len(model.langs))]
    keys = ["doc_id", "page_id", "h", "declared", "host", "domain", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(whole.column("t"), SLICE_BYTES):
                batch = whole.slice(a, b - a)
                logl = model.likelihoods(batch.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(logl[:, k]) for k in range(len(names)))], names=[*keys, *names])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    scored = cut(rows.select(*keys, "t").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{n} double" for n in names)])))
    langs = range(len(names) - 1)

    # soft counts of each language from the text alone
    top = F.greatest(*names)
    share = [F.exp(F.col(n) - top) for n in names]
    total = reduce(lambda x, y: x + y, share)
    soft = scored.select(*keys[3:], *((s / total).alias(n) for s, n in zip(share, names, strict=True)))
    sums = [F.sum(names[k]).alias(names[k]) for k in langs]
    whole = soft.agg(*sums).head()
    counts = np.array([whole[k] or 0.0 for k in langs]) + 1.0
    overall = counts / counts.sum()

    def smoothed(level: DataFrame, above: list[Column]) -> list[Column]:
        n = reduce(lambda x, y: x + y, [F.col(names[k]) for k in langs])
        return [(F.col(names[k]) + SMOOTH * above[k]) / (n + SMOOTH) for k in langs]

    # suffix, domain, host: each level smoothed towards the one above
    hosts = cut(soft.groupBy("host", "domain", "suffix").agg(*sums))
    suffixes = hosts.groupBy("suffix").agg(*sums)
    suffixes = suffixes.select("suffix", *(c.alias(f"s{k}") for k, c in enumerate(smoothed(suffixes, [F.lit(float(p)) for p in overall]))))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(F.broadcast(suffixes), "suffix")  # 677 suffixes of two letters
    domains = domains.select("domain", "suffix", *(c.alias(f"d{k}") for k, c in enumerate(smoothed(domains, [F.col(f"s{k}") for k in langs]))))
    priors = hosts.join(domains, ["domain", "suffix"])
    priors = cut(priors.select("host", "domain", "suffix", *(F.log(c).alias(f"p{k}") for k, c in enumerate(smoothed(priors, [F.col(f"d{k}") for k in langs])))))

    def trust(col: str, prefix: str) -> DataFrame:
        """log P(value | language) for each value of ``col``; values are two or three letters, so the table is small."""
        seen = soft.where(F.coalesce(F.col(col), F.lit("")) != "").groupBy(col).agg(*sums)
        return seen.select(col, *(F.log((F.col(names[k]) + 0.1) / float(counts[k] + 0.1)).alias(f"{prefix}{k}") for k in langs))

    joined = (
        scored.join(priors, ["host", "domain", "suffix"])
        .join(F.broadcast(trust("declared", "m")), "declared", "left")  # 26^2 + 26^3 values at most
        .join(F.broadcast(trust("suffix", "a")), "suffix", "left")  # 26^2 values at most
    )
    zero = F.lit(0.0)
    logs = [F.col(names[k]) + F.col(f"p{k}") + F.coalesce(F.col(f"m{k}"), zero) + F.coalesce(F.col(f"a{k}"), zero) for k in langs]
    # texts of no language are declared and addressed like the corpus at large
    spread = lambda prefix: F.coalesce(F.log(reduce(lambda x, y: x + y, [F.exp(F.col(f"{prefix}{k}")) * float(overall[k]) for k in langs])), zero)
    logs.append(F.col(names[-1]) + float(np.log(OTHER_PRIOR)) + spread("m") + spread("a"))
    joined = joined.select(*keys, *(c.alias(n) for c, n in zip(logs, names, strict=True))).withColumn("top", F.greatest(*names))
    best = F.coalesce(*(F.when(F.col(n) == F.col("top"), F.lit(lang)) for n, lang in zip(names, model.langs, strict=True)))
    confidence = 1 / reduce(lambda x, y: x + y, [F.exp(F.col(n) - F.col("top")) for n in names])
    found = joined.select("doc_id", "page_id", "h", "host", "declared", best.alias("lang"), confidence.alias("confidence"))
    return found.withColumn("kept", (F.col("lang") != OTHER) & (F.col("confidence") >= LEAST))


def accepted(docs: DataFrame, model: Trigrams) -> DataFrame:
    """The rows of ``docs`` whose language is found; equal rows are decided alike. Columns stay as they are."""
    gone = cut(identify(from_documents(docs), model).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"), F.col("host").alias("gone_host")).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_h"]) & (source_of(docs) == gone["gone_host"])
    return docs.join(gone, same, "left_anti")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    found = identify(from_documents(docs).unionByName(from_pages(pages)), fit(docs))
    return found.select("doc_id", "page_id", "host", "declared", "lang", F.round("confidence", 6).alias("confidence"), "kept")
