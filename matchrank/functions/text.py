"""Text functions as column expressions: normalizers, tokens, stems, categories, n-grams."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters folded to ASCII before lowering (Turkish first), the stop words, the colour
# words, the suffixes in the order in which they are tried, and the allowed item values per word
FOLD_FROM = "İIıçÇğĞöÖşŞüÜâÂîÎûÛáÁàÀäÄãåÅéÉèÈêÊëËíÍìÌïÏñÑóÓòÒôÔõúÚùÙÿ"
FOLD_TO = "iiicCgGoOsSuUaAiIuUaAaAaAaaAeEeEeEeEiIiIiInNoOoOoOouUuUy"
STOPWORDS = ("a", "ve", "ile", "icin", "bir", "adet", "ad", "li", "set", "seti", "takim", "takimi", "urun", "model", "uyumlu", "orjinal", "orijinal")
COLORS = ("beyaz", "siyah", "kirmizi", "mavi", "yesil", "sari", "pembe", "mor", "gri", "lacivert", "kahverengi", "bej", "krem", "turuncu", "bordo", "gold", "altin", "gumus", "haki", "taba", "lila", "ekru", "vizon", "fume")
SUFFIXES = ("larin", "lerin", "lari", "leri", "lara", "lere", "larda", "lerde", "ndan", "nden", "dan", "den", "nin", "nun", "ler", "lar", "lik", "luk", "cuk", "cik", "ci", "cu", "si", "su", "u", "i")
GENDER_ALLOWED = {"kadin": ("kadin", "unisex", "unknown"), "bayan": ("kadin", "unisex", "unknown"), "erkek": ("erkek", "unisex", "unknown"), "unisex": ("kadin", "erkek", "unisex", "unknown")}
AGE_ALLOWED = {"bebek": ("bebek", "unknown"), "cocuk": ("cocuk", "bebek", "unknown"), "kiz": ("cocuk", "bebek", "unknown")}



# fixed values: how letters and signs that don't decompose are spelled in ASCII
STROKED = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ƒ": "f", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D"}
GREEK = dict(zip("αβγδεζηθικλμνξοπρςστυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia io".split(), strict=True))
SIGNS = {"™": "(tm)", "©": "(c)", "®": "(r)", "°": "deg", "±": "+-", "×": "x", "÷": "/", "·": "*", "€": "EUR", "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "•": "*", "¼": " 1/4 ", "½": " 1/2 ", "¾": " 3/4 "}


def decompositions() -> dict[str, str]:
    """Letters and signs of the first plane that decompose (NFKD) to ASCII and marks, by rule."""
    out = {}
    for code in range(0xA0, 0x10000):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if base != chr(code) and base and base.isascii():
            out[chr(code)] = base
    return out


def spellings() -> dict[str, str]:
    """``decompositions``, then signs, stroked, Greek and Cyrillic letters, marks of these dropped and capitals alike."""
    lower = GREEK | CYRILLIC
    marked = {}
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(ch))
        own = chr(code).lower()
        if own in lower or base in lower:
            marked[chr(code)] = lower[own] if own in lower else lower[base]
    return decompositions() | SIGNS | STROKED | marked


def _tables(known: dict[str, str]) -> tuple[str, str, dict[str, str]]:
    """Letters with one-letter spellings, these, and the others; the fold table's own entries come first."""
    one = {k: v for k, v in known.items() if len(v) == 1 and k not in FOLD_FROM}
    return "".join(one), "".join(one.values()), {k: v for k, v in known.items() if len(v) > 1 and k not in FOLD_FROM}


#: What remains after the fold table: by transliteration, and by decomposition alone.
_SPELLED = _tables(spellings())
_DECOMPOSED = _tables(decompositions() | {k: v for k, v in STROKED.items() if len(v) == 1})

def _spelled(c: Column, tables: tuple[str, str, dict[str, str]]) -> Column:
    """``c`` with all letters of the tables replaced. ASCII rows are left as they are after one look; rows
    with a letter of long spelling go through their characters."""
    short_from, short_to, long = tables
    letters = "".join(sorted(long))
    short = F.translate(c, FOLD_FROM + short_from, FOLD_TO + short_to)
    table = F.map_from_arrays(F.array(*map(F.lit, long)), F.array(*map(F.lit, long.values())))
    by_letter = F.array_join(F.transform(F.split(short, ""), lambda x: F.when(F.contains(F.lit(letters), x) & (x != ""), F.coalesce(F.try_element_at(table, x), x)).otherwise(x)), "")
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.when(F.translate(c, letters, "") != c, by_letter).otherwise(short)).otherwise(c)


_empty = "array<string>"


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def clean_text(c: Column) -> Column:
    """Null to empty, white space collapsed, ends trimmed, case kept."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _without_marks(c: Column) -> Column:
    return F.regexp_replace(c, "[\\u0300-\\u036f]", "")


def fold(c: Column) -> Column:
    """Letters of the fold table, then other letters and signs that have a spelling (Latin, Greek and Cyrillic
    letters, ligatures, enclosed and full-width forms), to ASCII, then lower case."""
    return F.lower(F.replace(_spelled(_text(c), _SPELLED), F.lit("ß"), F.lit("ss")))


def normalize_text(c: Column) -> Column:
    """Folded, ampersands to spaces, punctuation kept."""
    return F.trim(F.regexp_replace(F.replace(fold(c), F.lit("&"), F.lit(" ")), r"\s+", " "))


def normalize_words(c: Column) -> Column:
    """Folded, everything but ``[a-z0-9]`` to single spaces."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def normalize_hybrid(c: Column) -> Column:
    """Cleaned, lowered, dotless i to i, marks dropped by decomposition, the rest to single spaces."""
    plain = F.lower(_spelled(F.translate(F.lower(clean_text(c)), "ı", "i"), _DECOMPOSED))
    return F.trim(F.regexp_replace(_without_marks(plain), "[^a-z0-9]+", " "))


def normalize_vector(c: Column) -> Column:
    """I and İ to i first, then as for ``fold``; ampersands, plus signs and all else to single spaces."""
    plain = F.lower(_spelled(F.translate(_text(c), "Iİı", "iii"), _DECOMPOSED))
    return F.trim(F.regexp_replace(_without_marks(plain), "[^0-9a-z]+", " "))


def normalize_kept(c: Column) -> Column:
    """As ``normalize_vector`` but punctuation stays; only ampersands become spaces."""
    plain = F.lower(_spelled(F.translate(_text(c), "Iİı", "iii"), _DECOMPOSED))
    return F.trim(F.regexp_replace(F.replace(_without_marks(plain), F.lit("&"), F.lit(" ")), r"\s+", " "))


def lower_turkish(c: Column) -> Column:
    """Turkish lower case: dotted and dotless i stay apart; the combining dot is dropped."""
    return F.replace(F.lower(F.translate(F.coalesce(c.cast("string"), F.lit("")), "İI", "iı")), F.lit("̇"), F.lit(""))


def stem(token: Column) -> Column:
    """Tokens over four letters lose the first listed suffix that leaves three letters."""
    out = token
    for s in reversed(SUFFIXES):
        fits = F.endswith(token, F.lit(s)) & (F.length(token) - len(s) >= 3)
        out = F.when(fits, F.left(token, F.length(token) - len(s))).otherwise(out)
    return F.when(F.length(token) <= 4, token).otherwise(out)


def raw_tokens(normalized: Column) -> Column:
    """ASCII tokens in order, stop words out."""
    return F.filter(F.regexp_extract_all(normalized, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*STOPWORDS))


def token_set(normalized: Column) -> Column:
    """Distinct tokens and their stems."""
    both = F.flatten(F.transform(raw_tokens(normalized), lambda t: F.array(t, stem(t))))
    return F.array_distinct(F.filter(both, lambda t: ~t.isin(*STOPWORDS)))


def query_tokens(normalized: Column) -> Column:
    """Per token itself if new, else its stem if new; so stems come in only for repeated words."""

    def step(seen: Column, token: Column) -> Column:
        root = stem(token)
        added = F.when(~F.array_contains(seen, token), F.array(token)).when((root != "") & ~root.isin(*STOPWORDS) & ~F.array_contains(seen, root), F.array(root)).otherwise(F.array().cast(_empty))
        return F.concat(seen, added)

    return F.aggregate(raw_tokens(normalized), F.array().cast(_empty), step)


def coverage(query: Column, field: Column) -> Column:
    """Share of the query's (distinct) tokens that the field has; 0 for an empty query."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, field)) / F.size(query))


def color_tokens(query: Column, lexicon: tuple[str, ...] = COLORS) -> Column:
    return F.array_intersect(query, _strings(lexicon))


def contains_query(query: Column, field: Column) -> Column:
    """1 if a non-empty query is a substring."""
    return F.when((query != "") & F.contains(field, query), 1.0).otherwise(0.0)


def token_set_similarity(a: Column, b: Column) -> Column:
    """The dependency-free fuzzy fallback: twice the common tokens over the sum of sizes."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def category_levels(c: Column, normalize=normalize_text) -> dict[str, Column]:
    """``cat_l1``, ``cat_l2``, ``cat_l3`` as growing paths and ``cat_leaf``; missing levels repeat the parent."""
    parts = F.filter(F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), "/"), normalize), lambda p: p != "")
    path = lambda k: F.array_join(F.slice(parts, F.lit(1), F.least(F.size(parts), F.lit(k))), "/")
    known = lambda x: F.when(F.size(parts) > 0, x).otherwise("unknown")
    return {"cat_l1": known(path(1)), "cat_l2": known(path(2)), "cat_l3": known(path(3)), "cat_leaf": known(F.try_element_at(parts, F.lit(-1)))}


def starter_tokens(c: Column) -> Column:
    """Distinct tokens of two letters or more under Turkish lowering."""
    return F.array_distinct(F.filter(F.split(lower_turkish(c), "[^0-9a-zçğıöşü]+"), lambda t: F.length(t) >= 2))


def search_text(weights: dict[str, int], normalize=normalize_text) -> Column:
    """Fields joined by spaces, each repeated by its weight; empty fields left out."""
    parts = [F.nullif(normalize(F.col(name)), F.lit("")) for name, times in weights.items() for _ in range(times)]
    return F.concat_ws(" ", *parts)


MINER_WEIGHTS = {"title": 2, "brand": 2, "category": 1, "attributes": 1}
CACHE_WEIGHTS = {"title": 1, "brand": 1, "category": 1, "attributes": 1}
VECTOR_WEIGHTS = {"title": 3, "category": 2, "brand": 2, "attributes": 1}
DISPLAY_FIELDS = ("title", "category", "brand", "gender", "age_group", "attributes")
DISPLAY_FIELDS_BRAND_FIRST = ("title", "brand", "category", "gender", "age_group", "attributes")


def display_text(fields: tuple[str, ...] = DISPLAY_FIELDS) -> Column:
    """Non-empty cleaned fields joined by `` | ``."""
    return F.concat_ws(" | ", *[F.nullif(clean_text(F.col(f)), F.lit("")) for f in fields])


def pair_key(term: Column, item: Column) -> Column:
    return F.concat_ws("\t", term, item)


def source_family(source: Column) -> Column:
    """lexical, embedding or uniform; a backfilled source belongs to the family it filled."""
    backfill = F.regexp_extract(source, "^uniform_backfill_(.+)$", 1)
    name = F.when(backfill != "", backfill).otherwise(source)
    return F.when(F.contains(name, F.lit("tfidf")) | F.endswith(name, F.lit("lexical")), "lexical").when(F.contains(name, F.lit("embedding")), "embedding").otherwise("uniform")


def rate_suffix(rate: float) -> str:
    """``r22`` for .22: the suffix of a decision's files and columns, halves to even."""
    return f"r{round(rate * 100):02d}"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; interpreted lambdas evaluate what isn't bound anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """Adjacent tokens joined by one space, all lengths from ``low`` to ``high``."""

    def grown(t: Column, grams: Column, n: int) -> Column:
        """Grams of n tokens from those of n - 1 and the tokens that follow them."""
        more = F.greatest(F.size(t) - n + 1, F.lit(0))
        return F.zip_with(F.slice(grams, F.lit(1), more), F.slice(t, F.lit(n), more), lambda a, b: F.concat(a, F.lit(" "), b))

    def every(t: Column) -> Column:
        grams, out = t, [t] if low <= 1 else []
        for n in range(2, high + 1):
            grams = grown(t, grams, n)
            out += [grams] if n >= low else []
        return F.concat(*out)

    return let(tokens, every)


def char_ngrams(normalized: Column, low: int = 2, high: int = 5) -> Column:
    """Within-word character n-grams; each word is padded by one space on both sides, and a padded
    word no longer than n gives itself once and no longer grams."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        per = []
        for n in range(low, high + 1):
            whole = F.when(size <= n, F.array(padded)).otherwise(_cuts(padded, size, n))
            per.append(whole if n == low else F.when(size <= n - 1, F.array().cast(_empty)).otherwise(whole))
        return F.concat(*per)

    return F.flatten(F.transform(F.filter(F.split(normalized, r"\s+"), lambda w: w != ""), of))


def _cuts(padded: Column, size: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda k: F.substring(padded, k, F.lit(n)))


def any_mismatch(query: Column, value: Column, field: Column, allowed: dict[str, tuple[str, ...]]) -> Column:
    """1 if a trigger word of the query excludes the item's value and the item lacks the word."""
    hit = [F.array_contains(query, w) & ~value.isin(*ok) & ~F.array_contains(field, w) for w, ok in allowed.items()]
    return F.when(reduce(lambda a, b: a | b, hit), 1.0).otherwise(0.0)
