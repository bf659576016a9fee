"""Predicates on fields as boolean columns that are never null: an absent field satisfies nothing but ``negate``."""

from __future__ import annotations

import base64
import ipaddress
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ip import v4_network, v4_number, v6_key, v6_masked
from .parse import found_parts, let, parts

NUMERIC = r"^-?\d+(\.\d+)?$"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_GROUP16 = "[0-9A-Fa-f]{1,4}"


def _ip6() -> str:
    """IPv6 addresses by the number of groups after ``::``, most first, so that the longest form is taken."""
    pair = f"(?:{_GROUP16}:{_GROUP16}|{_IP4})"
    arms = [f"(?:{_GROUP16}:){{6}}{pair}"]
    for after in (7, 6, 5, 4, 3, 2, 1, 0):  # groups after the gap; before it, what is left of seven
        before = 7 - after
        left = f"(?:(?:{_GROUP16}:){{0,{before - 1}}}{_GROUP16})?" if before else ""
        right = f"(?:{_GROUP16}:){{{after - 2}}}{pair}" if after >= 2 else _GROUP16 if after else ""
        arms.append(f"{left}::{right}")
    return "|".join(arms)


_MAPPED = f"::[fF]{{4}}:{_IP4}"
_ADDR = f"(?:{_MAPPED}|{_IP4}|{_ip6()})"
_LABEL = "(?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
# labels are bounded in length and number, as names are, so that a pattern's cost is bounded at each place of a line
_DNS = rf"(?:[A-Za-z0-9]{_LABEL}\.){{1,126}}[A-Za-z]{_LABEL}"
#: Named pieces of match patterns; each is one capture group of the compiled pattern. SRC and DEST are addresses; a DNS name
#: has dots, and its last label begins with a letter; a SUBNET's prefix may be left out.
TOKENS = {
    "IP4": _IP4,
    "IP6": f"{_MAPPED}|{_ip6()}",
    "ADDR": _ADDR,
    "DNS": _DNS,
    "HOST": f"{_ADDR}|{_DNS}",
    "SUBNET": f"{_ADDR}(?:/(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])(?![0-9]))?",
    "SRC": _ADDR,
    "DEST": _ADDR,
}


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def checked_regex(pattern: str) -> str:
    """The pattern as Java reads it like Perl (``.`` matches ``\\r``); what Java can't express is an error."""
    if re.search(r"\\K|\(\?R\)|\(\?\||\(\?&|\\g\{", pattern):
        raise ValueError(f"not expressible: {pattern}")
    return "(?d)" + pattern


def matcher_list(field: Column, values: list[str]) -> Column:
    """Equality with any value, or for a value in slashes a match of the pattern."""
    patterns = [v[1:-1] for v in values if len(v) > 1 and v[0] == v[-1] == "/"]
    plain = [v for v in values if not (len(v) > 1 and v[0] == v[-1] == "/")]
    return sure((field.isin(plain) if plain else F.lit(False)) | any_of([field.rlike(checked_regex(p)) for p in patterns]))


def decode_base64(candidates: Column) -> Column:
    """The texts of lenient base64 (what isn't in the alphabet is skipped) of all candidates; those that decode to nothing are none."""

    def text(kept: Column) -> Column:
        n = F.char_length(kept) - (F.char_length(kept) % 4 == 1).cast("int")
        padded = F.rpad(F.substring(kept, F.lit(1), n), (n + 3 - (n + 3) % 4).cast("int"), F.lit("="))
        return F.make_valid_utf8(F.unbase64(padded).cast("string"))

    kept = lambda v: F.regexp_replace(F.substring_index(v, "=", 1), "[^A-Za-z0-9+/]++", "")
    return _there(F.transform(candidates, lambda v: let(kept(v), text)))


def decode_utf16(candidates: Column) -> Column:
    """All candidates as UTF-16, little or big endian, as bytes read one by one look: two of each at most. Halves of a pair that
    stand alone are skipped."""

    def text(raw: Column, charset: str, pair: str, lone: str) -> Column:
        # characters stand for bytes: runs of whole characters are kept, what else there is goes
        whole = F.when((F.char_length(raw) < F.octet_length(raw)) & raw.rlike("[\u00d8-\u00df]"), F.regexp_replace(raw, rf"(?s)\G({pair})|\G{lone}", "$1")).otherwise(raw)
        return F.decode(F.encode(whole, "ISO-8859-1"), charset)

    high, low = "[\u00d8-\u00db]", "[\u00dc-\u00df]"
    le = (rf"(?:.[^\u00d8-\u00df])++|.{high}.{low}", r".[\u00d8-\u00df]")
    be = (rf"(?:[^\u00d8-\u00df].)++|{high}.{low}.", r"[\u00d8-\u00df].")
    both = lambda raw: F.array(text(raw, "UTF-16LE", *le), text(raw, "UTF-16BE", *be))
    even = lambda v: F.substring(v, F.lit(1), F.char_length(v) - F.char_length(v) % 2)
    narrow = lambda v: F.when(F.char_length(v) == F.octet_length(v), v).otherwise(F.regexp_replace(v, r"[^\u0000-\u00ff]++", ""))
    return _there(F.flatten(F.transform(F.filter(candidates, lambda v: v.isNotNull()), lambda v: let(let(narrow(v), even), both))))


def _there(candidates: Column) -> Column:
    return F.filter(candidates, lambda v: F.coalesce(v != "", F.lit(False)))


def needle_forms(text: str, form: str) -> list[str]:
    """What a searched text looks like when encoded: base64 at its three alignments, or with wide characters."""
    if form == "base64offset":
        out = []
        for k in range(3):
            coded = base64.b64encode(b" " * k + text.encode()).decode().rstrip("=")
            begin, end = (0, 2, 3)[k], len(coded) - (0 if (k + len(text.encode())) % 3 == 0 else 1)
            out.append(coded[begin:end])
        return out
    if form == "wide":
        return ["".join(c + "\x00" for c in text)]
    raise ValueError(form)


def decode(candidates: Column, steps: list[str]) -> Column:
    """array<string> of candidates after a chain of decoders, left to right."""
    for step in steps:
        if step in ("lower", "upper"):
            candidates = F.transform(candidates, F.lower if step == "lower" else F.upper)
        elif step == "url":  # %XX only: a plus sign stays
            candidates = F.filter(F.transform(candidates, lambda v: F.coalesce(F.try_url_decode(F.replace(F.regexp_replace(v, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))), v)), lambda v: v.isNotNull())
        elif step == "windash":
            candidates = F.transform(candidates, lambda v: F.translate(v, "‐‑‒–—―", "------"))
        elif step in ("base64", "utf16"):
            candidates = decode_base64(candidates) if step == "base64" else decode_utf16(candidates)
        else:
            raise ValueError(step)
    return candidates


#: Decoders that change the needle, not the value.
FORMS = ("base64offset", "wide")


def in_network(value: Column, cidr: str) -> Column:
    """Is the address in the network, of either family? What is no address or no network never is."""
    try:
        net = ipaddress.ip_network(cidr, strict=False)
    except ValueError:
        return F.lit(False)
    if net.version == 6:
        first = net.network_address.packed.hex()
        return sure(let(v6_key(value), lambda k: v6_masked(k, F.lit(net.prefixlen))) == F.lit(first)) if net.prefixlen else sure(v6_key(value).isNotNull())
    first = int(net.network_address)
    return sure(v4_number(value).between(first, first + net.num_addresses - 1))


def _in_field(ip: Column, net: Column) -> Column:
    """Is the address in the network that a field holds, both of one family? Without a prefix a network is one address; a
    prefix that is no number of its family makes it none."""
    halves = F.split(net, "/")
    first, given = F.element_at(halves, 1), F.try_element_at(halves, F.lit(2))
    prefix = lambda most: F.when(F.size(halves) == 1, F.lit(most)).when((F.size(halves) == 2) & given.rlike(r"^\d{1,3}$"), given.try_cast("int"))
    four = let(v4_number(first), lambda n: (prefix(32) == 0) & n.isNotNull() & v4_number(ip).isNotNull() | (v4_network(v4_number(ip), prefix(32)) == v4_network(n, prefix(32))))
    six = let(F.struct(v6_key(first).alias("n"), v6_key(ip).alias("k")), lambda x: (prefix(128) == 0) & x["n"].isNotNull() & x["k"].isNotNull() | (v6_masked(x["k"], prefix(128)) == v6_masked(x["n"], prefix(128))))
    return F.when(F.instr(net, ":") > 0, F.coalesce(six, four)).otherwise(four)


@dataclass
class Predicate:
    """One test of a field. ``op``: eq contains startswith endswith re gt lt ge le cidr exists."""

    field: str
    op: str
    values: list = field(default_factory=list)
    all: bool = False
    negate: bool = False
    nocase: bool = False
    fieldref: bool = False
    decode: list[str] = field(default_factory=list)

    def column(self, of: dict[str, Column]) -> Column:
        """``of``: field name -> string column; a name that isn't there is an absent field."""
        absent = F.lit(None).cast("string")
        value = of.get(self.field, absent)
        if self.op == "exists":
            if self.values:
                raise ValueError("exists takes no value")
            test = value.isNotNull()
        else:
            join = all_of if self.all else any_of
            forms = [s for s in self.decode if s in FORMS]
            steps = [s for s in self.decode if s not in FORMS]
            needles = [of.get(v, absent) if self.fieldref else F.lit(str(v)) for v in self.values]
            if forms:  # the value is searched for what the needle looks like when coded
                test = join([any_of([sure(self._one(value, F.lit(n))) for f in forms for n in needle_forms(str(v), f)]) for v in self.values])
            elif steps:
                test = let(decode(F.array(value), steps), lambda candidates: join([_some(candidates, self, n) for n in needles]))
            elif self.op == "cidr" and not self.fieldref:
                test = join([in_network(value, str(v)) for v in self.values])
            else:
                test = join([sure(self._one(value, n)) for n in needles])
        return ~test if self.negate else test

    def _one(self, value: Column, needle: Column) -> Column:
        if self.nocase and self.op != "re":
            value, needle = F.lower(value), F.lower(needle)
        if self.op == "re":
            return value.rlike(needle) if self.fieldref else F.regexp_like(value, F.concat(F.lit("(?i)(?d)" if self.nocase else "(?d)"), needle))
        if self.op in ("gt", "lt", "ge", "le"):
            number = lambda c: F.when(c.rlike(NUMERIC), c.try_cast("double"))
            a, b = number(value), number(needle)
            return {"gt": a > b, "lt": a < b, "ge": a >= b, "le": a <= b}[self.op]
        if self.op == "cidr":
            return let(F.struct(value.alias("ip"), needle.alias("net")), lambda x: _in_field(x["ip"], x["net"]))
        return {"eq": value == needle, "contains": F.contains(value, needle), "startswith": F.startswith(value, needle), "endswith": F.endswith(value, needle)}[self.op]


def _some(candidates: Column, p: Predicate, needle: Column) -> Column:
    return sure(F.exists(candidates, lambda c: sure(p._one(c, needle))))


def gate(tests: list[Predicate], of: dict[str, Column]) -> Column:
    return all_of([t.column(of) for t in tests])


def keywords(fields: Column, message: Column, words: list[str], within: str = "ANY", negate: bool = False, nocase: bool = False) -> Column:
    """Any word contained in any value of the map and the message, or in the values at or below one path."""
    if within == "ANY":
        values = F.concat(F.coalesce(F.map_values(fields), F.array().cast("array<string>")), F.array(message))
    else:
        values = F.map_values(F.map_filter(fields, lambda k, v: (k == within) | k.startswith(within + ".")))
    fold = F.lower if nocase else (lambda c: c)
    hit = any_of([_holds_word(values, fold, w.lower() if nocase else w) for w in words])
    return ~hit if negate else hit


def _holds_word(values: Column, fold, word: str) -> Column:  # noqa: ANN001
    return sure(F.exists(values, lambda v: sure(F.contains(fold(v), F.lit(word)))))


def condition(text: str, selections: dict[str, Column]) -> Column:
    """Named selections joined by and, or, not and parentheses, with ``all of`` and ``N of`` them or a prefix."""
    words = re.findall(r"\(|\)|[\w*]+", text)
    if not selections or "".join(words) != re.sub(r"\s+", "", text) or not words:
        raise ValueError(f"empty or unreadable condition: {text!r}")
    at = 0

    def take() -> str:
        nonlocal at
        at += 1
        return words[at - 1] if at <= len(words) else ""

    def peek(k: int = 0) -> str:
        return words[at + k].lower() if at + k < len(words) else ""

    def either() -> Column:
        left = both()
        while peek() == "or":
            take()
            left = left | both()
        return left

    def both() -> Column:
        left = single()
        while peek() == "and":
            take()
            left = left & single()
        return left

    def single() -> Column:
        word = take()
        if word.lower() == "not":
            return ~single()
        if word == "(":
            inner = either()
            if take() != ")":
                raise ValueError(f"unbalanced: {text!r}")
            return inner
        if peek() == "of":
            take()
            group = take()
            mine = list(selections.values()) if group == "them" else [c for n, c in selections.items() if group.endswith("*") and n.startswith(group[:-1])]
            need = len(mine) if word.lower() == "all" else 1 if word.lower() == "any" else int(word)
            if not mine or not 1 <= need <= len(mine):
                raise ValueError(f"impossible quantifier: {text!r}")
            return sum((c.cast("int") for c in mine), F.lit(0)) >= need
        if word not in selections:
            raise ValueError(f"unknown selection {word!r}")
        return selections[word]

    whole = either()
    if at != len(words):
        raise ValueError(f"unreadable condition: {text!r}")
    return whole


def compile_tokens(pattern: str) -> tuple[str, list[str]]:
    """A pattern with ``%%%%NAME%%%%`` pieces and ``(?<name>...)`` groups -> (Java pattern, names of its groups in order)."""
    names: list[str] = []

    def put(m: re.Match) -> str:
        if m[1]:
            names.append(m[1])
            return f"({TOKENS[m[1]]})"
        if m[2]:
            names.append(m[2])
            return "("
        if m[0] == "(":
            names.append("")
        return m[0]

    out = re.sub(r"%%%%(\w+)%%%%|\(\?<(\w+)>|\((?!\?)|\\.|\[(?:[^\]\\]|\\.)*\]", put, checked_regex(pattern))
    return out, names


def extract_tokens(text: Column, pattern: str) -> dict[str, Column]:
    """Named captures of one match. A name that repeats takes the first group that took part."""
    java, names = compile_tokens(pattern)
    out: dict[str, list[Column]] = {}
    for k, n in enumerate(names):
        if n:
            out.setdefault(n, []).append(F.nullif(F.regexp_extract(text, java, k + 1), F.lit("")))
    return {n: F.coalesce(*cs) for n, cs in out.items()}


def capture_names(patterns: list[str]) -> list[str]:
    return list(dict.fromkeys(n for p in patterns for n in compile_tokens(p)[1] if n))


def needed_text(java: str) -> str:
    """The longest text that every match of a pattern holds, as far as it can be told: what stands outside groups, classes
    and choices and isn't repeated. Empty if there is none."""
    runs, run, depth, k = [], "", 0, 0
    if java.startswith("(?d)"):
        k = 4
    if re.search(r"\(\?\^?[a-z]*[ix]|\\[QE]", java):  # case or spaces don't count, or quoting
        return ""
    while k < len(java):
        c, step, plain = java[k], 1, None
        if c == "\\":
            step = 2
            if not java[k + 1 : k + 2].isalnum():
                plain = java[k + 1 : k + 2]
            elif java[k + 1] not in "dDwWsSbBtnrAzZhHvVR":
                return ""
        elif c == "[":
            m = re.compile(r"\[\^?\]?(?:\\.|[^\]\\\[])*\]").match(java, k)
            if m is None:  # classes inside classes
                return ""
            step = m.end() - k
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return ""
        elif c == "{" or c in "?*+":
            step = java.index("}", k) + 1 - k if c == "{" else 1
            run = run[:-1]
        elif c not in "^$.|":
            plain = c
        if plain is not None and depth == 0:
            run += plain
        else:
            runs.append(run)
            run = ""
        k += step
    return max([*runs, run], key=len)


def holds(text: Column, java: str) -> Column:
    """A cheap test that lines which a pattern can match pass: no regular expression is run on the others."""
    word = needed_text(java)
    return F.contains(text, F.lit(word)) if word else F.lit(True)


def first_match(text: Column, patterns: list[str]) -> Column:
    """struct(pattern: index of the first pattern that matches, then its captures by name), or null.

    Patterns are tried in order, each only on lines that hold the text it needs; one pass tells whether it matches and
    reads all its groups."""
    names = capture_names(patterns)
    absent = F.lit(None).cast("string")

    def attempt(k: int) -> Column:
        java, groups = compile_tokens(patterns[k])
        number = F.lit(k).alias("pattern")

        def read(x: Column) -> Column:
            mine = {n: F.coalesce(*(x[f"g{g}"] for g, m in enumerate(groups) if m == n)) for n in names if n in groups}
            return F.when(x.isNotNull(), F.struct(number, *(mine.get(n, absent).alias(n) for n in names)))

        # before and after the match anything may stand; the pattern's own dots stay as they are
        take = found_parts if needed_text(java) else lambda text, java, names: parts(text, f"(?s:.*?)(?-s:{java})(?s:.*)", names)
        hit = let(take(text, java, [f"g{g}" for g in range(len(groups))]), read) if groups else F.when(text.rlike(java), F.struct(number, *(absent.alias(n) for n in names)))
        out = F.when(holds(text, java), hit)
        return F.coalesce(out, attempt(k + 1)) if k + 1 < len(patterns) else out

    return attempt(0)


def ignored(text: Column, patterns: list[str]) -> Column:
    """True where any pattern vetoes the line."""
    return any_of([sure(holds(text, checked_regex(p)) & text.rlike(checked_regex(p))) for p in patterns])


def compose_fields(parsed: Column, lifted: Column, captures: Column, captures_win: bool = True) -> Column:
    """Fields of a match from maps: parsed < lifted < captures on text types, captures < lifted < parsed otherwise."""
    order = [parsed, lifted, captures] if captures_win else [captures, lifted, parsed]
    none = F.create_map().cast("map<string,string>")
    kept = [F.map_filter(F.coalesce(m, none), lambda k, v: v.isNotNull()) for m in order]
    out = kept[0]
    for m in kept[1:]:
        out = F.map_concat(_without(out, m), m)
    return out


def _without(m: Column, keys_of: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(keys_of), k))
