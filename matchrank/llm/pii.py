"""Personal data: regular expressions propose spans, checksums confirm, nearby words adjust the score.

A score starts at its kind's prior, rises where one of the kind's own words stands, whole, within 40
characters of the text before or after the span, and falls where a word does that speaks against it. Spans of the
base kinds always stay; spans of the other kinds stay if their score reaches a threshold, which some
of them can only with their context.

Native throughout: each row is handled by itself with SQL functions, so nothing is shuffled.
``split`` and ``regexp_extract_all`` run the same Java matcher, so the pieces between matches and
the matches alternate; running lengths of both give each match's place in code points. Patterns
are possessive and anchored at the start of a run, so long runs cost linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchrank.llm.native import let

#: Elements per block of the two-level running sum; a work size, not a limit.
_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: how it is proposed, when a quick look rules it out, who vouches."""

    name: str
    pattern: str
    hint: str
    valid: object
    prior: float
    context: str
    against: str = "(?!)"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octet(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def _ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), _octet)


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), F.call_function("luhn_check", d)).otherwise(False)


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15)


def _iban(m: Column) -> Column:
    """ISO 13616: move four characters back, letters become 10..35, remainder 1 modulo 97."""
    bare = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97))
    return F.length(bare).between(15, 34) & (rest == 1)


#: Characters of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _ssn(m: Column) -> Column:
    """US social security number: no area 000, 666 or above 899, no group 00, no serial 0000."""
    return ~m.rlike("^(?:000|666|9)|-00-|-0000$")


def _imei(m: Column) -> Column:
    return F.call_function("luhn_check", _digits(m))


def _iban_pattern() -> str:
    """A known country's match ends at its length; another's runs on, though not into a next IBAN."""
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    exact = [rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()]
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]|\x20(?![A-Z]{{2}}[0-9]{{2}})[A-Z0-9]){{11,30}}"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*exact, other])})(?![A-Za-z0-9])"


#: Order is the order of report. The first four are the base kinds; a failing match isn't retried.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.9, "e?mail|contact|write|kontakt|correo|courriel", "example|noreply|no-reply"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _ip, 0.6, "ip|host|server|address|addresses|adresse|adressen|login", "version|release|section|v[0-9]+"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _card, 0.8, "card|visa|mastercard|credit|karte|kreditkarte|tarjeta|carte|payment", "isbn|order|serial|part"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _phone, 0.6, "phone|telephone|telefon|tel|call|mobile|fax|anruf|llamar|llame|llamada", "score|sum|plus"),
    Kind("iban", _iban_pattern(), "", _iban, 0.8, "iban|bank|account|konto|cuenta|compte", "hash|serial|licen[cs]e key"),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-", _ssn, 0.4, "ssn|social security|taxpayer|tax id", "phone|telephone|tel|fax|part|order|isbn"),
    Kind("imei", r"(?<![0-9A-Za-z-])[0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{6}[ -]?[0-9](?![0-9A-Za-z-])", "", _imei, 0.3, "imei|handset|device|phone|telefon|móvil", "card|order|isbn|invoice"),
)
RAISED, LOWERED, NEAR = 0.2, 0.2, 40
#: The score from which spans of kinds beyond the base ones stay.
LEAST_SCORE = 0.5
BASE = ("email", "ip", "card", "phone")


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefixes of an int array under ``step`` (with 0 as its neutral element) in two
    levels, so that long arrays don't cost n squared."""
    grow = lambda items: F.aggregate(items, F.array(F.lit(0).cast("int")), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x).cast("int"))))
    cut = lambda v: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")),
        lambda b: let(grow(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))), lambda g: F.slice(g, F.lit(2), F.size(g))),
    )
    joined = lambda blocks: let(
        grow(F.transform(blocks, lambda b: F.element_at(b, -1))),
        lambda starts: F.flatten(F.transform(blocks, lambda b, i: let(F.get(starts, i), lambda at: F.transform(b, lambda x: step(x, at))))),
    )
    return F.when(F.size(values) > 0, let(values, lambda v: let(cut(v), joined))).otherwise(F.array().cast("array<int>"))


def running_sum(lengths: Column) -> Column:
    return running(lengths, lambda a, b: a + b)


def proposals(text: Column, pattern: str, body) -> Column:
    """``body(matches, ends)`` of a pattern's leftmost non-overlapping matches."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return let(
        found,
        lambda x: let(
            running_sum(F.zip_with(F.slice(x["p"], F.lit(1), F.size(x["m"])), x["m"], lambda p, m: F.length(p) + F.length(m))),
            lambda ends: body(x["m"], ends),
        ),
    )


#: Characters per block of a text that is read at many places; a work size, not a limit.
_CUT = 1024


def cut_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))


def _between(blocks: Column, s: Column, e: Column) -> Column:
    """Characters s to e of a text that is cut in blocks; only the blocks in between are read."""
    first, last = F.floor(s / _CUT).cast("int"), F.floor(e / _CUT).cast("int")
    at = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    inner = F.when(last - first > 1, F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")).otherwise("")
    apart = F.concat(F.substring(at(first), s % _CUT + 1, F.lit(_CUT)), inner, F.substring(at(last), F.lit(1), e % _CUT))
    return F.when(e <= s, "").when(first == last, F.substring(at(first), s % _CUT + 1, e - s)).otherwise(apart)


def whole_words(words: str) -> str:
    """An expression for any of the words, alone or in the plural, not inside another word."""
    return rf"(?<![\p{{L}}\p{{N}}])(?:{words})s?(?![\p{{L}}\p{{N}}])"


def surroundings(blocks: Column, s: Column, e: Column) -> Column:
    """Lower-case text within 40 characters of a span on both sides; words cut by that distance are left out."""
    before, after = _between(blocks, F.greatest(s - NEAR - 1, F.lit(0)), s), _between(blocks, e, e + NEAR + 1)
    kept = lambda side, cut, run: F.when(cut, F.regexp_replace(side, run, "")).otherwise(side)
    return F.lower(F.concat(kept(before, s > NEAR, r"^[\p{L}\p{N}]+"), F.lit("\n"), kept(after, F.length(after) > NEAR, r"[\p{L}\p{N}]+$")))


def _spans(text: Column, kind: Kind) -> Column:
    none = F.array().cast("array<struct<kind:string,s:int,e:int,score:double>>")
    look = F.lit(True)
    if kind.hint:
        look = F.contains(text, F.lit(kind.hint))
    look = look & text.rlike(kind.pattern)
    points = lambda words: kind.prior + F.when(words.rlike(whole_words(kind.context)), RAISED).otherwise(0.0) - F.when(words.rlike(whole_words(kind.against)), LOWERED).otherwise(0.0)
    score = lambda blocks, s, e: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), let(surroundings(blocks, s, e), points))), 2)
    span = lambda s, e, blocks: F.struct(F.lit(kind.name).alias("kind"), s.alias("s"), e.alias("e"), score(blocks, s, e).alias("score"))
    each = lambda blocks: lambda matches, ends: F.filter(
        F.transform(matches, lambda m, i: F.when(kind.valid(m), span(F.get(ends, i) - F.length(m), F.get(ends, i), blocks))),
        lambda y: y.isNotNull(),
    )
    return F.when(look, let(cut_blocks(text), lambda blocks: proposals(text, kind.pattern, each(blocks)))).otherwise(none)


def span_array(text: Column, least: float = LEAST_SCORE) -> Column:
    """``array<struct<kind,s,e,score>>`` of a text, without the spans of added kinds below ``least``."""
    spans = F.concat(*[_spans(text, k) for k in KINDS])
    return F.filter(spans, lambda x: x["kind"].isin(*BASE) | (x["score"] >= least)) if least > 0 else spans


def find_spans(docs: DataFrame, text_col: str = "text", out: str = "pii_spans", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with ``out``: ``array<struct<kind,s,e,score>>`` in code points, end exclusive.

    Ordered by kind as in ``KINDS``, then by start. Null text counts as empty and has no spans; an
    existing column called ``out`` is replaced. Spans of different kinds may overlap. Whole words
    near a span change its score, whatever other spans lie between; spans of added kinds below
    ``least`` are left out, base kinds stay. Rows are independent: repeated or null ids and any other
    columns stay as they are, an empty table stays empty.
    """
    return docs.withColumn(out, span_array(F.coalesce(F.col(text_col).cast("string"), F.lit("")), least))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; rows and columns stay.

    Overlapping spans become one replacement named after the first. A null text stays null, a text
    without spans as it was. Rows are independent, whatever their ids; columns may have any names; an
    empty table stays empty. The text is cut in blocks once, so that many spans of a long text don't
    each count its characters from the start.
    """
    name = next(n for n in (f"_pii{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    text = F.col(text_col)
    # by start, the longer first: a span that begins before all earlier ones have ended joins their replacement
    order = lambda spans: F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))

    def rewritten(blocks: Column) -> Column:
        def pieces(spans: Column, ends: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            piece = lambda x, i: let(before(i), lambda at: F.when(x["s"] >= at, F.concat(_between(blocks, at, x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))))
            return F.concat(F.array_join(F.transform(spans, piece), ""), _between(blocks, F.element_at(ends, -1), F.length(text)))

        return let(order(F.col(name)), lambda spans: let(running(F.transform(spans, lambda x: -x["e"]), F.greatest), lambda ends: pieces(spans, ends)))

    return find_spans(docs, text_col, name, least).withColumn(text_col, F.when(F.size(name) > 0, let(cut_blocks(text), rewritten)).otherwise(text)).select(*docs.columns)
