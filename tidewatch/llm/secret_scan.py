"""Secrets in texts: known shapes, and long tokens that pass a battery of randomness tests.

DataFrame operations only. Each token of 20 and more characters with letters and digits has its encoding
inferred (hex, base32, base64), and three tests ask whether its symbols are drawn uniformly: chi-squared
over the alphabet, in as many equal parts as the length allows, runs about its middle, and serial correlation. Fisher's method
combines them. Over the whole corpus, and apart for each class of length, the Benjamini-Hochberg procedure
rejects randomness at a set rate of false rejections: rejected tokens are ordinary, the others secrets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .spans import holding, let, merged, number_of, running, spelt, with_matches

PATTERNS = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",
    "random": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
BASE = ("assign", "access", "hex")
SCORE = {"assign": 90, "access": 95, "hex": 60, "random": 70}
#: Least lengths of the length classes of tokens; the test has its own power in each.
CLASSES = (20, 28, 36, 48, 64)
#: Parts of the alphabet for chi-squared, and the symbols from which a token has so many: five are expected in each.
PARTS = ((64, 320), (32, 160), (16, 80), (8, 40), (4, 20))
#: False rejections of randomness among all rejections.
RATE = 0.05
#: p-values are counted in tenths of a decade, down to 10^-20.
BINS = 200
#: Symbols of the encodings, in the order of their values.
HEX, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Abramowitz and Stegun 7.1.26, for erfc.
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to 1.5e-7; at least 1e-30."""
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for a in reversed(ERFC):
        poly = (poly + a) * t
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-30))


def tested(found: Column) -> Column:
    """FOUND spans of tokens -> array of (s, e, m, before, after, class, bin) of those that can be tested: letters and
    digits mixed, and 20 symbols of their alphabet at least without the padding at the end."""

    def infer(x: Column) -> Column:
        m = F.translate(F.rtrim(F.translate(x["m"], "=", " ")), "-_ ", "+/=")
        alphabet = F.when(m.rlike("^[0-9a-f]+$"), HEX).when(m.rlike("^[0-9A-F]+$"), HEX_UPPER).when(m.rlike("^[A-Z2-7]+$"), BASE32).otherwise(BASE64)
        return F.struct(x.alias("x"), m.alias("m"), alphabet.alias("alphabet"))

    mixed = lambda t: (F.char_length(t["m"]) >= CLASSES[0]) & t["m"].rlike("[0-9]") & t["m"].rlike("[A-Za-z]")

    def symbols(t: Column) -> Column:
        at = F.transform(F.filter(F.split(t["m"], ""), lambda c: c != ""), lambda c: F.position(c, t["alphabet"]) - 1)
        return F.struct(t["x"].alias("x"), t["m"].alias("m"), F.char_length(t["alphabet"]).alias("a"), F.filter(at, lambda i: i >= 0).alias("at"))

    enough = lambda t: F.size(t["at"]) >= CLASSES[0]

    def statistics(t: Column) -> Column:
        n, a, at = F.size(t["at"]), t["a"], t["at"]
        parts = F.least(a, F.coalesce(*(F.when(n >= least, c) for c, least in PARTS)))
        fits = _squares(F.transform(at, lambda i: F.floor(i * parts / a).cast("int"))) * parts / n - n
        next_to = F.zip_with(F.slice(at, 1, n - 1), F.slice(at, 2, n - 1), lambda i, j: F.struct(i.alias("i"), j.alias("j")))
        changes = F.size(F.filter(next_to, lambda p: (p["i"] * 2 >= a) != (p["j"] * 2 >= a)))
        centred = lambda i: (i + 0.5) / a - 0.5
        serial = F.aggregate(next_to, F.lit(0.0), lambda acc, p: acc + centred(p["i"]) * centred(p["j"]))
        return F.struct(
            t["x"].alias("x"), t["m"].alias("m"), fits.alias("fits"), parts.alias("parts"),
            (F.abs(changes - (n - 1) / 2) / (F.sqrt(n - 1) / 2)).alias("runs"), (F.abs(serial) * 12 / F.sqrt(n - 1)).alias("serial"),
        )

    def combined(t: Column) -> Column:
        logs = F.log(F.greatest(chi_squared(t["fits"], t["parts"]), F.lit(1e-30))) + F.log(erfc(t["runs"] / math.sqrt(2))) + F.log(erfc(t["serial"] / math.sqrt(2)))
        return F.struct(t["x"].alias("x"), t["m"].alias("m"), (-logs).alias("h"))

    def binned(t: Column) -> Column:
        x, h = t["x"], t["h"]
        p = F.exp(-h) * (1 + h + h * h / 2)  # chi-squared with six degrees of freedom
        tenth = F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-20)))).cast("int")
        kind = sum((F.when(F.char_length(t["m"]) >= n, 1).otherwise(0) for n in CLASSES[1:]), F.lit(0))
        return F.struct(*(x[c].alias(c) for c in ("s", "e", "m", "before", "after")), kind.alias("class"), F.greatest(F.lit(0), F.least(tenth, F.lit(BINS))).alias("bin"))

    found = F.filter(F.transform(F.filter(F.transform(found, infer), mixed), symbols), enough)
    for step in (statistics, combined, binned):
        found = F.transform(found, step)
    return found


def _squares(parts: Column) -> Column:
    """Sum of the squares of how often each value is in an array."""

    def add(acc: Column, x: Column) -> Column:
        again = F.when(x == acc["x"], acc["run"]).otherwise(0)
        return F.struct(x.alias("x"), (again + 1).alias("run"), (acc["sum"] + 2 * again + 1).alias("sum"))

    begin = F.struct(F.lit(-1).alias("x"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(F.array_sort(parts), begin, add, lambda acc: acc["sum"])


def chi_squared(x: Column, parts: Column) -> Column:
    """Chance that chi-squared with parts - 1 degrees of freedom (an odd number from 3 on) is x or more."""
    series = F.aggregate(F.sequence(F.floor(parts / 2).cast("int") - 1, F.lit(1)), F.lit(1.0), lambda acc, k: F.when(k * 2 < parts - 2, 1 + x / (2 * k + 1) * acc).otherwise(acc))
    return F.least(F.lit(1.0), erfc(F.sqrt(x / 2)) + F.sqrt(x * 2 / math.pi) * F.exp(-x / 2) * series)


def limits(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> list[int]:
    """For each class of length the least bin that rejects randomness, by Benjamini-Hochberg over all tokens of the corpus.

    What comes to the driver is one number for each class; the histogram has 5 x 201 rows at most.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = with_matches(texts, "t", {"random": PATTERNS["random"]})
    tokens = found.where(F.size("_random") > 0).select(F.explode(tested(F.col("_random"))).alias("x")).select("x.class", "x.bin")
    bins = tokens.groupBy("class", "bin").agg(F.count("*").alias("n"))
    downward = Window.partitionBy("class").orderBy(F.desc("bin"))
    bins = bins.withColumns({"upto": F.sum("n").over(downward), "m": F.sum("n").over(Window.partitionBy("class"))})
    rejecting = bins.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= rate * F.col("upto") / F.col("m"))
    by_class = {r["class"]: r["least"] for r in rejecting.groupBy("class").agg(F.min("bin").alias("least")).collect()}
    return [by_class.get(k, BINS + 1) for k in range(len(CLASSES))]


def confirmed(kind: str, x: Column) -> Column:
    if kind == "assign":
        return F.char_length(F.regexp_extract(x["m"], r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)$""", 1)) >= 12
    return F.lit(True)


def scan(docs: DataFrame, rejecting: list[int], text_col: str = "text") -> DataFrame:
    """Add ``secrets``: array of (s, k, e, kind, score), by start, then kind as in PATTERNS. ``rejecting``: of limits().

    Null text counts as empty; a text without matches has an empty array; repeated rows are scanned each;
    an empty table stays empty. Columns of ``docs`` stay, but for ``secrets`` and those that begin with
    ``_secret``.
    """
    found = with_matches(docs.withColumn("_secret_text", F.coalesce(F.col(text_col), F.lit(""))), "_secret_text", PATTERNS, "_secret_")
    found = found.withColumn("_secret_random", tested(F.col("_secret_random")))
    limit = F.lit(rejecting)
    kept = {k: holding(F.col(f"_secret_{k}"), confirmed, k) for k in BASE}
    kept["random"] = F.filter("_secret_random", lambda x: x["bin"] < F.element_at(limit, x["class"] + 1))
    return found.withColumn("secrets", merged(kept, lambda kind, x: F.lit(SCORE[kind]))).drop("_secret_text", *(f"_secret_{k}" for k in PATTERNS))


def redacted(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """The text with each span replaced; of spans that overlap, what the first leaves over is replaced with it.

    Pieces are cut from the text in four bytes a character, where a place is found without counting."""
    n = F.size(spans)

    def cut(wide: Column, ends: Column) -> Column:
        piece = lambda a, b: F.decode(F.substring(wide, a * 4 + 1, (b - a) * 4), "UTF-32")
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), n - 1))
        rows = F.zip_with(spans, before, lambda x, at: F.struct(x["s"].alias("s"), at.alias("at")))
        pieces = F.transform(F.filter(rows, lambda x: x["s"] >= x["at"]), lambda x: F.concat(piece(x["at"], x["s"]), F.lit(by)))
        return F.concat(F.array_join(pieces, ""), piece(F.element_at(ends, -1), F.char_length(text)))

    ends = running(F.transform(spans, lambda x: x["e"]), lambda x, y: F.greatest(x, y), 0)
    return F.when(n > 0, let(F.encode(text, "UTF-32"), lambda wide: let(ends, lambda e: cut(wide, e)))).otherwise(text)


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (text, n_chars, ...) with every secret replaced; n_chars follows where the text changes. No row goes.

    Other columns stay as they are, whatever their names."""
    rejecting = limits(docs)
    apart = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    found = scan(apart, rejecting).withColumn("_redacted", redacted(F.col("text"), F.col("secrets")))
    some = F.size("secrets") > 0
    changed = {"text": F.when(some, F.col("_redacted")).otherwise(F.col("text")), "n_chars": F.when(some, F.char_length("_redacted").cast("long")).otherwise(F.col("_row.n_chars"))}
    return found.select(*(changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`") for c in docs.columns))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, limits(docs))
    base = F.filter("secrets", lambda x: x["k"] < len(BASE))
    n = {f"n_{k}": number_of(F.col("secrets"), k) for k in BASE}
    return found.select("doc_id", *(c.alias(k) for k, c in n.items()), F.sha2(spelt(base), 256).alias("base_sha256"), spelt(F.col("secrets")).alias("spans"))


#: The plain forms of the base patterns, and of the tokens.
_PLAIN = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "random": "[A-Za-z0-9+/_=-]{20,}",
}
_HOLDS = {
    "assign": "length(regexp_extract(x.m, '" + _PLAIN["assign"].replace("'", "''") + "', 2)) >= 12",
    "access": "length(x.m) >= 18",
    "hex": "length(x.m) >= 16",
    "random": "true",
}


def _kind_sql(n: int, kind: str) -> str:
    pattern = _PLAIN[kind].replace("'", "''")
    return f"""
    select doc_id, {n} as k, '{kind}' as kind, x.s as s, x.s + length(x.m) as e, x.m as m
    from (select doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
                 'm': m[i], 'w': length(m[i]), 's': list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)}})) as x
          from (select doc_id, case when '{kind}' = 'hex' then hm else regexp_extract_all(t, '{pattern}') end as m,
                       case when '{kind}' = 'hex' then hp else string_split_regex(t, '{pattern}') end as p
                from (select *, regexp_extract_all(t, '[0-9a-f]{{16,}}') as hm, string_split_regex(t, '[0-9a-f]{{16,}}') as hp from docs)))
    where {_HOLDS[kind]}"""


def _erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * {x}))"
    poly = "0.0::double"
    for a in reversed(ERFC):
        poly = f"({poly} + {a}::double) * {t}"
    return f"greatest({poly} * exp(-({x}) * ({x})), 1e-30)"


ORACLE = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
base as ({" union all ".join(_kind_sql(n, k) for n, k in enumerate(BASE))}),
tokens as (select doc_id, s::bigint as s, e::bigint as e, translate(rtrim(m, '='), '-_', '+/') as m, row_number() over () as id from ({_kind_sql(3, "random")})),
inferred as (select *, case when regexp_full_match(m, '[0-9a-f]+') then '{HEX}' when regexp_full_match(m, '[0-9A-F]+') then '{HEX_UPPER}'
                            when regexp_full_match(m, '[A-Z2-7]+') then '{BASE32}' else '{BASE64}' end as alphabet
             from tokens where length(m) >= {CLASSES[0]} and regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')),
symbols as (select *, length(alphabet) as a, list_filter(list_transform(regexp_extract_all(m, '.'), lambda c: strpos(alphabet, c) - 1), lambda i: i >= 0) as idx from inferred),
pairs as (select *, len(idx)::double as n, least(a, case {" ".join(f"when len(idx) >= {least} then {c}" for c, least in PARTS)} end) as parts, list_transform(range(1, len(idx)), lambda i: {{'i': idx[i], 'j': idx[i + 1]}}) as near from symbols where len(idx) >= {CLASSES[0]}),
statistics as (select *,
    list_sum(list_transform(range(parts), lambda q: pow(len(list_filter(idx, lambda i: i * parts // a = q)), 2))) * parts / n - n as fits,
    abs(len(list_filter(near, lambda p: (p.i * 2 >= a) <> (p.j * 2 >= a))) - (n - 1) / 2) / (sqrt(n - 1) / 2) as runs,
    abs(list_sum(list_transform(near, lambda p: ((p.i + 0.5) / a - 0.5) * ((p.j + 0.5) / a - 0.5)))) * 12 / sqrt(n - 1) as serial from pairs),
fitted as (select *, list_reduce(list_prepend(1.0::double, range(parts // 2 - 2, 0, -1)::double[]), lambda s, k: 1 + fits / (2 * k + 1) * s) as series from statistics),
combined as (select *, -(ln(greatest(least(1.0, {_erfc_sql("sqrt(fits / 2)")} + sqrt(fits * 2 / pi()) * exp(-fits / 2) * series), 1e-30))
                         + ln({_erfc_sql("(runs / sqrt(2))")}) + ln({_erfc_sql("(serial / sqrt(2))")})) as h from fitted),
binned as (select *, {" + ".join(f"(length(m) >= {n})::int" for n in CLASSES[1:])} as class,
                  greatest(0, least({BINS}, floor(-10 * log10(greatest(exp(-h) * (1 + h + h * h / 2), 1e-20)))))::int as bin from combined),
histogram as (select class, bin, sum(count(*)) over (partition by class order by bin desc) as upto, sum(count(*)) over (partition by class) as total from binned group by class, bin),
rejecting as (select class, min(bin) as least_bin from histogram where pow(10.0, -bin / 10.0) <= {RATE} * upto / total group by class),
spans as (select doc_id, k, kind, s::bigint as s, e::bigint as e from base
          union all select doc_id, 3, 'random', s, e from binned left join rejecting using (class) where bin < coalesce(least_bin, {BINS + 1}))
select d.doc_id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)},
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < {len(BASE)}), '')) as base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k), '') as spans
from docs d left join spans using (doc_id) group by d.doc_id
"""
