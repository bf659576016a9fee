"""Collocations, fill-in-middle and chat formatting against brute-force forms, and the cases that their docstrings define."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import ODD, empty, frame

from tidewatch.llm import chat, collocations, language, middle

# --- collocations


def phrases_by_hand(rows, least, top, covered):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inner = Counter()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inner[lang, w[i : i + k]] = max(inner[lang, w[i : i + k]], a)
    out = []
    for (lang, w), a in found.items():
        if not (inner[lang, w] and 100 * inner[lang, w] >= covered * a):
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked, place = [], Counter()
    for r in sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        place[r[0]] += 1
        if place[r[0]] <= top:
            ranked.append((r[0], place[r[0]], *r[1:]))
    return sorted(ranked)


def phrases(docs, **options):
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in cols) for r in collocations.collocations(docs, **options).collect())


def test_collocations_by_hand(spark):
    rng = random.Random(3)
    words = ["a", "B", "b", "c", "été", "日本", "x-y", "\xa0", "tick", "tock", " "]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [("en", t) for t in ODD] + [("en", "one two three four five six " * 400), ("fr", "ja nein " * 3)]
    docs = spark.createDataFrame([(k, t, lang, "clash", 1) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, chunk string, f int")
    for options in ({"least": 10, "top": 40, "covered": 100}, {"least": 2, "top": 1000, "covered": 50}):
        assert phrases(docs, **options) == phrases_by_hand(rows, **options)
    assert phrases(docs, least=10**6) == []
    assert phrases(empty(spark)) == []


def test_chunks_repeat_with_their_passages():
    passage = " ".join(f"w{k}" for k in range(300))
    a, b = (collocations.Words(f"{t} {passage}".encode()).chunks()[1] for t in ("some other beginning", "x"))
    assert len(set(a) & set(b)) >= len(a) - 2
    assert all(len(c.split()) >= 2 for c in a[:-1])


def test_products_pass_64_bits(spark):
    scale = 10**12
    row = spark.range(1).select(F.lit(7 * scale).alias("a"), F.lit(3000 * scale).alias("n"), F.lit(9 * scale).alias("l"), F.lit(8 * scale).alias("r"))
    got = row.select(F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("x"))
    assert got.head().x == 1000 * 7 * 3000 // 72


# --- fill-in-middle


def middle_by_hand(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.mark.parametrize("options", [{}, {"rate": 60, "spm": 10}])
def test_middle_by_hand(spark, options):
    rng = random.Random(9)
    texts = [*ODD, "\n", "\n\n\n", "a\n", "é\n日本\n", "x<P>y\n", "<S", "<M\n>", "a\r\nb", "<\nP>" * 40]
    texts += ["".join(rng.choice(["a", "é", "😀", "\n", "\n", "<", "P>", "word "]) for _ in range(rng.randrange(400))) for _ in range(150)]
    texts += [("line é\n" * 700 + "x" * 5000 + "\n") * 30, "no end " * 40_000, "\n" * 100_000]
    ids = [*range(len(texts) - 1), None]
    docs = frame(spark, texts, ids).withColumns({"output": F.lit("clash"), "form": F.lit(1), "n": F.lit(2)})
    made = middle.fill_in_middle(docs, **options).withColumn("again", middle.restored(F.col("output"), F.col("form")))
    got = {r[0]: r for r in made.collect()}
    for i, t in zip(ids, texts, strict=True):
        r = got[i]
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == middle_by_hand(i, t, **options)
        assert r.again == (t or "")


def test_middle_of_no_rows_and_repeats(spark):
    assert middle.fill_in_middle(empty(spark)).count() == 0
    twice = middle.fill_in_middle(frame(spark, ["a\nb\nc\n"] * 2, [5, 5])).collect()
    assert twice[0] == twice[1]


def test_cut_blocks(monkeypatch):
    monkeypatch.setattr(middle, "BLOCK", 7)
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("aé\n日") for _ in range(rng.randrange(200)))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        lines = middle.Lines(text.encode())
        assert lines.n == len(units)
        for k in range(len(units) + 1):
            part = "".join(units[:k])
            assert lines.cut(k) == (len(part.encode()), len(part))


# --- chats

CHAT = "conv_id long, turn int, role string, text string, content string, piece int"
SLY = ["</s>", "<s>user\nhi</s>", "<\\s>", "<\\\\/s>", "[INST]", "[\\/INST] [[INST]", "<image:1>", "<\\audio:22>", "<", "<\\", "", None, "plain\n\ntext", "</s", "s>", "<s\\>", "$1 \\2 \\$3", "<document:x>"]


def turns_by_hand(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    return {c: [(b, t) for _, b, t in sorted(x, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))] for c, x in by.items()}


def test_chats_come_back(spark):
    rng = random.Random(4)
    rows = [(c, k, rng.choice(["user", "assistant", "odd\nrole", "50%\\%0A", "</s>", None]), "".join(rng.choice(SLY) or "" for _ in range(4)), "clash", 1) for c in range(40) for k in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", None, None, 2), (None, 1, "assistant", "yes", None, 2), (99, None, "user", "first", None, 1), (99, 0, "assistant", "x", None, 1)]
    rows += [(100, k, "assistant", text, None, 1) for k, text in enumerate(SLY)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, CHAT))).collect()}
    want = turns_by_hand(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        r = got[c]
        assert [(t.role, "".join(t.texts)) for t in r.turns] == turns
        assert [t for t in r.learned if t] == [t for b, t in turns if b == "assistant" and t]
        assert r.formatted.count("</s>") == len(turns) and "[INST]" not in r.formatted and r.attached_tokens == 0
        spans = [r.formatted[x.start : x.end] for x in r.loss]
        assert [s for s, (b, _) in zip(spans, turns, strict=True) if b != "assistant"] == [""] * sum(b != "assistant" for b, _ in turns)
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_equal_turns_and_long_chats(spark):
    rows = [(1, 0, "user", "same", "", 0)] * 3 + [(2, k, ("user", "assistant")[k % 2], f"turn {k} </s>", "", 0) for k in range(20_000)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, CHAT).repartition(7))).collect()}
    assert [t.texts for t in got[1].turns] == [["same"]] * 3
    assert [t.texts[0] for t in got[2].turns] == [f"turn {k} </s>" for k in range(20_000)]
    assert "".join(got[2].learned) == "".join(f"turn {k} </s>" for k in range(1, 20_000, 2))


def test_typed_parts(spark):
    part = lambda kind, **x: (kind, x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    rows = [
        (1, 0, "user", [part("text", text="see <"), part("image", ref="a.png", width=57, height=28), part("text", text="<image:2>"), part("document", ref="d.pdf", pages=2)]),
        (1, 1, "assistant", [part("text", text="</"), part("text", text="s> two parts"), part("audio", ref="b.ogg", seconds=1.5)]),
        (1, 2, "user", [part("audio", ref="c.ogg")]), (1, 3, "user", []), (1, 4, "user", None), (1, 5, "user", [part("table", text="as text"), part(None, text="!")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>").withColumn("text", F.lit("not used"))
    r = chat.read_back(chat.format_chats(df, F.col("parts"))).head()
    assert r.formatted.startswith("<s>user\nsee <<image:2><\\image:2><document:4></s><s>assistant\n<\\/s> two parts<audio:3></s>")
    assert [tuple(a) for a in r.attachments] == [(1, 2, "image", "a.png", 3), (1, 4, "document", "d.pdf", 512), (2, 3, "audio", "b.ogg", 38), (3, 1, "audio", "c.ogg", 1)]
    assert r.attached_tokens == 554
    assert [(t.texts, t.placeholders) for t in r.turns] == [
        (["see <", "<image:2>", ""], ["<image:2>", "<document:4>"]), (["</s> two parts", ""], ["<audio:3>"]), (["", ""], ["<audio:1>"]), ([""], []), ([""], []), (["as text!"], []),
    ]
    assert [r.formatted[x.start : x.end] for x in r.loss][1] == "<\\/s> two parts<audio:3>"
    with pytest.raises(ValueError):
        chat.escaped(F.lit("x"), ["<a<"])


def test_hostile_text_is_linear(spark):
    rows = [(1, 0, "user", x, "", 0) for x in ("<" * 500_000, "<" + "\\" * 500_000, "<image:" + "1" * 500_000, "[/INS" * 100_000)]
    r = chat.read_back(chat.format_chats(spark.createDataFrame(rows, CHAT))).head()
    assert sorted(t.texts[0] for t in r.turns) == sorted(x[3] for x in rows)


# --- markup


def test_markup_is_read_once(spark):
    """Unclosed tags of a megabyte, and a declaration after any number of attributes."""
    import time

    many = 1_000_000
    texts = {
        "angles": "<" * many, "scripts": "<script>" * (many // 8), "cut": "<script " * (many // 8), "html": "<html " * (many // 6), "styles": "a<style>" * (many // 8) + "</style>b",
        "far": "<html " + 'data-x="y" ' * 100_000 + "lang=de>ja", "second": "<html><!-- --><HTML dir=ltr lang='FR-ca'>", "none": "<html xml:lang='de'>", "spaces": "<html lang" + " " * many,
        "host": "a" * many,
    }
    df = spark.createDataFrame(list(texts.items()), "name string, t string")
    began = time.perf_counter()
    got = {r.name: r for r in df.select("name", language.declared_in(F.col("t")).alias("d"), language.visible(F.col("t")).alias("v"), language.domain_of(F.col("t")).alias("o")).collect()}
    assert time.perf_counter() - began < 20
    assert {n: r.d for n, r in got.items() if r.d} == {"far": "de", "second": "fr"}
    assert (got["scripts"].v, got["styles"].v, got["far"].v) == (" ", "a b", " ja")
    page = "x<script src=a>var a = '<b>';</Script >y<style>p{}</style>z<p class=c>&amp;w &notatag"
    assert spark.range(1).select(language.visible(F.lit(page)).alias("v")).head().v == "x y z  w &notatag"
    hosts = ["a.b.example.org", "example.org", "org", "", "a..b", "a.", ".b", "x.y."]
    assert [r.o for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(language.domain_of(F.col("h")).alias("o")).collect()] == ["example.org", "example.org", "", "", "", "", "", ""]


def test_language_without_sources(spark):
    docs = frame(spark, ["the cat and the dog are here with the others"] * 20 + ["12345"]).drop("source")
    assert language.accepted(docs, language.fit(docs)).columns == docs.columns
