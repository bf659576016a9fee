"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score.

DataFrame operations only. Patterns are possessive and begin at the first character of a run, or where
the match before ended: they match what the plain forms match, in time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import NEAR, holding, merged, number_of, spelt, with_matches

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
BASE = ("email", "ip", "card", "phone")
#: Score in hundredths of a confirmed match, and words that raise it when they stand near.
SCORE = {"email": 90, "ip": 50, "card": 80, "phone": 60, "iban": 90, "ssn": 20}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|ruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
}
RAISE = 30
#: Kinds besides the base ones are kept from this score on.
LEAST = 50


def luhn(digits: Column) -> Column:
    """True if the checksum holds; ``digits``: 20 ASCII digits at most."""
    padded = F.lpad(digits, 20, "0")

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(padded, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """True if the account number leaves 1 (letters count 10 to 35, the first four characters last)."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c >= "A", (acc * 100 + letter) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def confirmed(kind: str, x: Column) -> Column:
    m = x["m"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    if kind == "ssn":
        return ~F.right(x["before"], F.lit(1)).rlike("[0-9-]") & ~F.left(x["after"], F.lit(1)).rlike("[0-9-]")
    return F.lit(True)


def score(kind: str, x: Column) -> Column:
    near = F.lower(F.concat_ws(" ", x["before"], x["after"])).rlike(CONTEXT[kind])
    return F.least(F.lit(100), F.lit(SCORE[kind]) + F.when(near, RAISE).otherwise(0))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``pii``: array of (s, k, e, kind, score), by start, then kind as in PATTERNS.

    Null text counts as empty; a text without matches has an empty array; repeated rows are scanned
    each; an empty table stays empty. Columns of ``docs`` stay, but for ``pii`` and those that begin
    with ``_pii``.
    """
    found = with_matches(docs.withColumn("_pii_text", F.coalesce(F.col(text_col), F.lit(""))), "_pii_text", PATTERNS, "_pii_")
    kept = {k: holding(F.col(f"_pii_{k}"), confirmed, k) for k in PATTERNS}
    spans = F.filter(merged(kept, score), lambda x: (x["k"] < len(BASE)) | (x["score"] >= LEAST))
    return found.withColumn("pii", spans).drop("_pii_text", *(f"_pii_{k}" for k in PATTERNS))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["k"] < len(BASE))
    n = {f"n_{k}": number_of(F.col("pii"), k) for k in BASE}
    return found.select(
        "doc_id", *(c.alias(k) for k, c in n.items()), F.sha2(spelt(base), 256).alias("base_sha256"), spelt(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


#: The plain forms of PATTERNS.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
_HOLDS = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(x.m, '.'), lambda p: coalesce(try_cast(p as bigint) <= 255, false)))",
    "card": """length(x.d) between 14 and 19 and list_sum(list_transform(range(1, 21), lambda i:
        case when i % 2 = 0 then lpad(x.d, 20, '0')[i]::int
             when lpad(x.d, 20, '0')[i]::int > 4 then lpad(x.d, 20, '0')[i]::int * 2 - 9
             else lpad(x.d, 20, '0')[i]::int * 2 end)) % 10 = 0""",
    "phone": "length(x.d) between 10 and 15",
    "iban": """length(replace(x.m, ' ', '')) between 15 and 34 and list_reduce(list_prepend(0::bigint,
        list_transform(regexp_extract_all(replace(x.m, ' ', '')[5:] || x.m[1:4], '.'), lambda c: case when c >= 'A' then 1000 + ascii(c) - 55 else ascii(c) - 48 end)),
        lambda a, v: case when v >= 1000 then (a * 100 + v - 1000) % 97 else (a * 10 + v) % 97 end) = 1""",
    "ssn": "not regexp_matches(right(x.b, 1), '[0-9-]') and not regexp_matches(x.a[1:1], '[0-9-]')",
}


def _kind_sql(n: int, kind: str) -> str:
    pattern = _PLAIN[kind].replace("'", "''")
    return f"""
    select doc_id, {n} as k, '{kind}' as kind, x.s as s, x.s + length(x.m) as e,
           least(100, {SCORE[kind]} + case when regexp_matches(lower(right(x.b, {NEAR}) || ' ' || x.a[1:{NEAR}]), '{CONTEXT[kind]}') then {RAISE} else 0 end) as score
    from (select doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
                 'm': m[i], 'd': regexp_replace(m[i], '[^0-9]', '', 'g'), 'b': p[i], 'a': p[i + 1],
                 's': length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i - 1], ''))}})) as x
          from (select doc_id, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as p from docs))
    where {_HOLDS[kind]}"""


ORACLE = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
spans as ({" union all ".join(_kind_sql(n, k) for n, k in enumerate(PATTERNS))}),
kept as (select * from spans where k < {len(BASE)} or score >= {LEAST})
select d.doc_id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)},
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < {len(BASE)}), '')) as base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k), '') as spans,
       coalesce(string_agg(score::varchar, ',' order by s, k), '') as scores
from docs d left join kept using (doc_id) group by d.doc_id
"""
