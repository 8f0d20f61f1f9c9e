"""SQL spellings of the text functions, for the DuckDB twins."""

from __future__ import annotations

from matchrank.functions import text

_stop = ", ".join(f"'{s}'" for s in text.STOPWORDS)


def fold(x: str) -> str:
    return f"lower(replace(strip_accents(translate(coalesce({x}, ''), '{text.FOLD_FROM}', '{text.FOLD_TO}')), 'ß', 'ss'))"


def normalize(x: str) -> str:
    return f"trim(regexp_replace(replace({fold(x)}, '&', ' '), '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def stem(t: str) -> str:
    whens = " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) - {len(s)} >= 3 THEN left({t}, length({t}) - {len(s)})" for s in text.SUFFIXES)
    return f"(CASE WHEN length({t}) <= 4 THEN {t} {whens} ELSE {t} END)"


def raw_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '[a-z0-9]+'), lambda t: t NOT IN ({_stop}))"


def token_set(x: str) -> str:
    return f"list_distinct(list_filter(flatten(list_transform({raw_tokens(x)}, lambda t: [t, {stem('t')}])), lambda t: t NOT IN ({_stop})))"


def query_tokens(x: str) -> str:
    one = f"CASE WHEN NOT list_contains(a, b[1]) THEN b WHEN {stem('b[1]')} <> '' AND {stem('b[1]')} NOT IN ({_stop}) AND NOT list_contains(a, {stem('b[1]')}) THEN [{stem('b[1]')}] ELSE [] END"
    lists = f"list_transform({raw_tokens(x)}, lambda t: [t])"
    return f"(CASE WHEN length({raw_tokens(x)}) = 0 THEN [] ELSE list_reduce({lists}, lambda a, b: a || {one}) END)"


def coverage(q: str, f: str) -> str:
    return f"(CASE WHEN length({q}) = 0 THEN 0.0::DOUBLE ELSE length(list_filter({q}, lambda t: list_contains({f}, t)))::DOUBLE / length({q}) END)"


def parts(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), '/'), lambda p: {normalize('p')}), lambda p: p <> '')"
