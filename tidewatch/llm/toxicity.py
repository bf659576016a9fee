"""Toxicity: Levenshtein automata over a lexicon trie, with context windows that tell quotation from abuse.

The lexicon (whole words, and stems that any ending may follow) and all weights are learned from labelled
documents. A word is looked up by the product of the trie and an automaton of one edit (a letter too many, too few,
another one, or two that changed places), made deterministic as words ask for it. Words with symbols or digits between
them are looked up as one, where a symbol may stand for any letter; letters that repeat are also read as one. A hit counts
as quoted when it stands in quotation marks or near a reporting verb; quoted and other hits are separate evidence of a
logistic model.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from .common import table

#: Labelled documents that the lexicon and the model are fitted on, at most.
TRAIN_DOCS = 8000
#: Lengths of stems.
STEMS = range(4, 9)
#: A term needs so many toxic documents, so much log lift of its rate, and such a likelihood ratio of document counts.
LEAST_DOCS, LEAST_LIFT, LEAST_G = 5, 1.5, 24.0
#: Shorter terms allow no edit.
EDIT_FROM = 5
#: Words on each side of a hit in which a reporting verb makes it a quotation.
WINDOW = 4
REPORTING = frozenset("said says say wrote writes quoted quotes called calls told dit écrit selon sagte schrieb zitiert laut dijo escribió según".split())
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
#: Words that one worker remembers.
CACHE_WORDS = 500_000

WORD = re.compile(r"[^\W\d_]+")
#: A word, and the next one that up to three digits or symbols part from it.
PARTED = re.compile(r"(?<![^\W\d_])([^\W\d_]++)(?=((?:[\d_]|[^\w\s]){1,3})([^\W\d_]++))")
SYMBOL = re.compile(r"[\W_]")
#: Stands for any one letter in a word that is looked up.
ANY = "*"
#: Kinds of a hit, each with its own lift: exact, an edit, an edit of the first letter, symbols or digits inside, letters repeated.
EXACT, EDITED, FIRST, INSIDE, REPEATED = KINDS = range(5)


@dataclass
class Term:
    text: str
    stem: bool


class Lexicon:
    """Deterministic product of the trie of terms and the one-edit automaton, built as it is walked. Only with ``first``
    may the edit be that of the first letter.

    A member of a state is (node, kind of the edit so far, letter that must come next or ''): of two letters that changed
    places the second is read first, and the first is then due."""

    def __init__(self, terms: list[Term], first: bool = False):
        self.first = first
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.terms = terms
        for n, t in enumerate(terms):
            at = 0
            for c in t.text:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                at = self.child[at][c]
            self.ends[at].append(n)
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.whole: list[tuple[int, int] | None] = []  # (kind, term) at the end of a word
        self.open: list[tuple[int, int] | None] = []  # the same for stems, wherever a word gets to
        self.begin = self.state({(0, 0, "")})
        self.seen: dict[str, tuple[int, int] | None] = {}
        #: the terms that symbols may stand in, and their numbers here; only asked for words with such
        self.masked: Lexicon | None = None
        self.long = [n for n, t in enumerate(terms) if len(t.text) >= EDIT_FROM]
        #: terms without repeated letters, for words that repeat them
        self.single: dict[str, int] = {}
        for n, t in enumerate(terms):
            if not t.stem and len(squeezed(t.text)) >= EDIT_FROM:
                self.single.setdefault(squeezed(t.text), n)

    def state(self, at: set[tuple[int, int, str]]) -> int:
        # a missing letter: go down the trie without reading
        at |= {(c, self.edit(node), "") for node, e, due in at if e == 0 and not due and (node or self.first) for c in self.child[node].values()}
        key = frozenset(x for x in at if not any((x[0], e, x[2]) in at for e in range(x[1])))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            found = [(e, n) for node, e, due in key if not due for n in self.ends[node] if e == 0 or len(self.terms[n].text) >= EDIT_FROM]
            self.whole.append(min((x for x in found if not self.terms[x[1]].stem), default=None))
            self.open.append(min((x for x in found if self.terms[x[1]].stem), default=None))
        return self.ids[key]

    @staticmethod
    def edit(node: int) -> int:
        return EDITED if node else FIRST

    def step(self, state: int, c: str) -> int:
        to = set()
        for node, e, due in self.sets[state]:
            child = self.child[node]
            if due:
                if c in (due, ANY):
                    to.add((node, e, ""))
                continue
            if c == ANY:
                to |= {(x, e, "") for x in child.values()}
            elif c in child:
                to.add((child[c], e, ""))
            if e == 0 and (node or self.first):
                to.add((node, self.edit(node), ""))  # a letter too many
                to |= {(x, self.edit(node), "") for x in child.values()}  # another letter
                to |= {(self.child[x][c], self.edit(node), other) for other, x in child.items() if other != c and c in self.child[x]}  # two that changed places
        made = self.next[state][c] = self.state(to)
        return made

    def walk(self, word: str) -> tuple[int, int] | None:
        state, best = self.begin, None
        for c in word:
            state = self.next[state].get(c, -1) if c in self.next[state] else self.step(state, c)
            if not self.sets[state]:
                return best
            found = self.open[state]
            if found is not None and (best is None or found < best):
                best = found
        found = self.whole[state]
        return found if found is not None and (best is None or found < best) else best

    def look(self, word: str) -> tuple[int, int] | None:
        """(kind, term) of the best match of a whole word."""
        if word in self.seen:
            return self.seen[word]
        best = self.walk(word)
        if best is None and (short := squeezed(word)) != word:
            if short in self.single:
                best = (REPEATED, self.single[short])
            elif (found := self.walk(short)) is not None and found[0] == EXACT and self.terms[found[1]].stem and len(self.terms[found[1]].text) >= EDIT_FROM:
                best = (REPEATED, found[1])
        if len(self.seen) >= CACHE_WORDS:
            self.seen.clear()
        self.seen[word] = best
        return best

    def parted(self, a: str, between: str, b: str) -> int | None:
        """The term that two words are with what parts them, if neither is a hit of it."""
        found = self.look(a + between + b) if len(between) == 1 else None
        if found is None and SYMBOL.search(between) and len(a) + len(b) >= 3:
            if self.masked is None:
                self.masked = Lexicon([self.terms[n] for n in self.long], self.first)
            found = self.masked.look(a + SYMBOL.sub(ANY, between) + b)
            found = (INSIDE, self.long[found[1]]) if found is not None and found[0] == EXACT else None
        if found is None or any(x is not None and x[1] == found[1] for x in (self.look(a), self.look(b))):
            return None
        return found[1]

    def hits(self, text: str) -> tuple[int, list[tuple[int, int, bool]]]:
        """Number of words, and (term, kind, quoted) of each hit.

        Words parted by digits or symbols are also looked up as one; they count for a term that neither is a hit of."""
        low = text.lower()
        words = WORD.findall(low)
        look, seen = self.look, self.seen
        for w in set(words).difference(seen):
            look(w)
        at = [i for i, w in enumerate(words) if look(w) is not None]
        found = [(i, i + 1, *look(words[i])) for i in at]
        parted = [(m.start(), term) for m in PARTED.finditer(low) if (term := self.parted(m[1], m[2], m[3])) is not None]
        if not found and not parted:
            return len(words), []
        where = [m.span() for m in WORD.finditer(low)]
        for start, term in parted:
            i = bisect_left(where, (start, 0))
            found.append((i, i + 2, INSIDE, term))
        inside = quoted_ranges(low)
        out = []
        for i, j, kind, term in sorted(found):
            near = words[max(0, i - WINDOW) : i] + words[j : j + WINDOW]
            k = int(np.searchsorted(inside[:, 0], where[i][0], "right")) - 1
            quoted = not REPORTING.isdisjoint(near) or (k >= 0 and where[j - 1][1] <= inside[k, 1])
            out.append((term, kind, quoted))
        return len(words), out


def squeezed(word: str) -> str:
    """The word with letters that repeat written once."""
    return re.sub(r"(.)\1+", r"\1", word)


def quoted_ranges(text: str) -> np.ndarray:
    """Starts and ends of quotations, ascending: from a mark to its counterpart in the same paragraph."""
    out, marks = [], [(m.start(), m[0]) for m in re.finditer(r"\n\s*\n|[" + "".join({*QUOTES, *QUOTES.values()}) + "]", text)]
    i, alone = 0, set()  # marks that have no counterpart in the rest of the paragraph
    while i < len(marks):
        at, mark = marks[i]
        if mark.isspace():
            alone.clear()
        elif mark in QUOTES and mark not in alone:
            k = i + 1
            while k < len(marks) and marks[k][1] != QUOTES[mark] and not marks[k][1].isspace():
                k += 1
            if k < len(marks) and not marks[k][1].isspace():
                out.append((at, marks[k][0] + 1))
                i = k
            else:
                alone.add(mark)
        i += 1
    return np.array(out, np.int64).reshape(-1, 2)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learn_terms(train: DataFrame) -> list[Term]:
    """Terms whose rate in toxic text is far above that in other text. ``train``: (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, times = [Counter(), Counter()], [Counter(), Counter()]
        size, total = [0, 0], [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine: Counter = Counter()
                words = WORD.findall((text or "").lower())
                for w, n in Counter(words).items():
                    mine["=" + w] += n
                    for k in STEMS:
                        if len(w) >= k:
                            mine["^" + w[:k]] += n
                times[toxic].update(mine)
                docs[toxic].update(mine.keys())
                size[toxic] += 1
                total[toxic] += len(words)
        terms = list(docs[0].keys() | docs[1].keys())
        cols = [[c[t] for t in terms] for c in (*docs, *times)]
        ends = [*size, *total]  # under the empty term: documents and words of each class
        yield pa.RecordBatch.from_arrays([pa.array([*terms, ""]), *(pa.array([*c, n], pa.int64()) for c, n in zip(cols, ends, strict=True))], names=["term", "d0", "d1", "n0", "n1"])

    sums = train.select("text", F.col("toxic").cast("int")).mapInArrow(count, "term string, d0 long, d1 long, n0 long, n1 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("d0", "d1", "n0", "n1")))
    totals = sums.where("term = ''").head()
    if totals is None or not totals.n0 or not totals.n1:
        return []
    lift = F.log((F.col("n1") + 0.5) / F.lit(float(totals.n1))) - F.log((F.col("n0") + 0.5) / F.lit(float(totals.n0)))
    d0, d1, all0, all1 = F.col("d0"), F.col("d1"), float(totals.d0), float(totals.d1)
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)
    share = (d0 + d1) / (all0 + all1)
    g = 2 * (part(d1, share * all1) + part(d0, share * all0) + part(all1 - d1, (1 - share) * all1) + part(all0 - d0, (1 - share) * all0))
    good = sums.where((F.col("term") != "") & (d1 >= LEAST_DOCS) & (d1 * all0 > d0 * all1)).withColumns({"lift": lift, "g": g})
    # of at most TRAIN_DOCS documents: all that are good, the best first
    best = good.where((F.col("lift") >= LEAST_LIFT) & (F.col("g") >= LEAST_G)).orderBy(F.desc("g"), F.desc(F.length("term")), "term").collect()
    chosen: list[Term] = []
    stems, heads, whole = set(), set(), set()  # chosen stems, all beginnings of chosen terms, chosen terms
    for r in best:  # a term says nothing more than the stem it begins with
        text, stem = r.term[1:], r.term[0] == "^"
        begins = {text[:k] for k in range(1, len(text) + 1)}
        if text not in whole and stems.isdisjoint(begins) and not (stem and text in heads):
            chosen.append(Term(text, stem))
            whole.add(text)
            heads |= begins
            if stem:
                stems.add(text)
    return chosen


@dataclass
class Model:
    terms: list[Term]
    lift: np.ndarray  # terms x kinds
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def features(self, n_words: int, hits: list[tuple[int, int, bool]]) -> list[float]:
        plain = quoted = most = 0.0
        for term, kind, inside in hits:
            x = self.lift[term, kind]
            if inside:
                quoted += x
            else:
                plain += x
            most = max(most, x)
        root = math.sqrt(n_words + 10)
        return [math.log1p(plain), plain / root, math.log1p(quoted), quoted / root, most, math.log1p(n_words)]

    def score(self, rows: list[list[float]]) -> np.ndarray:
        x = (np.array(rows).reshape(-1, len(self.mean)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _lexicon(terms: list[Term], held: dict[tuple, Lexicon]) -> Lexicon:
    key = tuple((t.text, t.stem) for t in terms)
    if key not in held:
        held.clear()
        held[key] = Lexicon(terms, first=True)
    return held[key]


_held: dict[tuple, Lexicon] = {}


def fit(train: DataFrame) -> Model:
    """``train``: (text, toxic 0/1), TRAIN_DOCS rows at most, whose counts of hits come to the driver."""
    terms = learn_terms(train)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(terms, _held)
        for batch in batches:
            found = [lexicon.hits(t or "") for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "n": [n for n, _ in found], "hits": [[x for h in hs for x in map(int, h)] for _, hs in found]})

    got = train.select("text", F.col("toxic").cast("int")).mapInPandas(find, "toxic int, n int, hits array<int>").collect()
    y = np.array([r.toxic for r in got], float)
    hits = [[(h[i], h[i + 1], bool(h[i + 2])) for i in range(0, len(h), 3)] for h in (r.hits for r in got)]
    # lifts of each kind by its own occurrences
    times = np.zeros((2, len(terms), len(KINDS)))
    words = np.ones(2)
    for r, hs in zip(got, hits, strict=True):
        words[r.toxic] += r.n
        for term, kind, _ in hs:
            times[r.toxic, term, kind] += 1
    lift = np.log((times[1] + 0.5) / words[1]) - np.log((times[0] + 0.5) / words[0])
    if len(terms):
        lift[:, 1:] = np.where(times[:, :, 1:].sum(axis=0) == 0, lift[:, :1] / 2, lift[:, 1:])
    lift = np.maximum(lift, 0)
    model = Model(terms, lift, np.zeros(7), np.zeros(6), np.ones(6))
    x = np.array([model.features(r.n, hs) for r, hs in zip(got, hits, strict=True)]).reshape(-1, 6)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the share of toxic rows
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        model.weights[0] = math.log(p / (1 - p))
        return model
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    w = np.zeros(7)
    ridge = np.diag([1e-9, *[0.1] * 6])
    for _ in range(50):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    model.weights = w
    return model


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fifth; of more than ``most``, those of least hash.

    A text counts once, and as toxic if any of its rows is labelled so; of more than ``most`` texts (ids that repeat), those of
    least hash. The rows are written, since the fit reads them more than once."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # TRAIN_DOCS rows of two numbers
    texts = written(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("text")), "training")
    least = texts.select("h").orderBy("h").limit(most).distinct()
    return texts.join(F.broadcast(least), "h", "left_semi").select("text", "toxic")  # TRAIN_DOCS numbers


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_terms) for each row; null text counts as empty.

    A text without words has the score of no evidence; repeated rows are scored each; an empty table gives
    no rows. Only the text is read: labels, language, source and id have no part in a score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(model.terms, _held)
        for batch in batches:
            found = [lexicon.hits(t or "") for t in batch.column(2).to_pylist()]
            p = model.score([model.features(n, hs) for n, hs in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(h) for _, h in found], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted", "n_terms"],
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_terms int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(training_rows(docs, table(spark, sf_dir, "labels"))))
