"""License texts through a positional index of rare words.

Native throughout and row by row: nothing is shuffled. Templates are word sequences, passages of
whole licences among them. Of each, the two words with the highest inverse document frequency among
the templates are posted with their offsets. A file's words are looked up in that index once; a
posting proposes its template at a relative position, the postings of a template's two words are
intersected by that position, and a place counts if the template's key phrase stands there word for
word and enough of the other words agree.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchrank.llm.native import let

# fixed value: what separates words, upper-case ASCII letters being lowered first
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words`` in a row; ``key`` is the part that must agree exactly; ``share`` of all words must."""

    label: str
    words: str
    key: str
    share: float = 0.9
    base: bool = False


def _phrase(label: str, words: str, base: bool = False) -> Template:
    return Template(label, words, words, 1.0, base)


# fixed values: the base phrases, names and passages of public licences
TEMPLATES = (
    _phrase("mit", "mit license", True),
    _phrase("apache", "apache license", True),
    _phrase("gpl", "general public license", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    Template("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "publish distribute sublicense and or sell copies"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    Template("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", "authors or copyright holders be liable for any claim"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "required by applicable law or agreed to in writing"),
    Template("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of", "perpetual worldwide non exclusive no charge royalty free irrevocable"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu", "redistribute it and or modify it under the terms"),
    Template("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu", "without even the implied warranty"),
    Template("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim copies of this license document"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    Template("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    _phrase("mpl", "mozilla public license"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "this source code form is subject to the terms"),
    _phrase("lgpl", "lesser general public license"),
    _phrase("agpl", "affero general public license"),
    _phrase("epl", "eclipse public license"),
    _phrase("bsl", "boost software license"),
    _phrase("cc-by-nc", "cc by nc"),
    _phrase("cc-by-sa", "cc by sa"),
    _phrase("cc-by-nc", "attribution noncommercial"),
    _phrase("cc-by-sa", "attribution sharealike"),
    Template("cc0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of", "overtly fully permanently irrevocably and unconditionally waives"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "either in source code form or as a compiled binary"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "without any express or implied warranty in no event will the authors"),
    Template("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "must be plainly marked as such and must not be misrepresented"),
)


@dataclass(frozen=True)
class Entry:
    """A template with the offsets of its two rarest words, the rarest first, and of its key."""

    template: Template
    rare: tuple[int, int]
    key_at: int
    idf: float

    @property
    def tokens(self) -> list[str]:
        return self.template.words.split()


def entries(templates: tuple[Template, ...] = TEMPLATES) -> list[Entry]:
    """Per template its two rarest words' offsets, ties to the earlier word."""
    df = Counter(w for t in templates for w in set(t.words.split()))
    out = []
    for t in templates:
        words = t.words.split()
        idf = [math.log((1 + len(templates)) / df[w]) for w in words]
        order = sorted(range(len(words)), key=lambda i: (-idf[i], i))
        key = t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out.append(Entry(t, (order[0], order[1]), at, idf[order[0]]))
    return out


def postings(index: list[Entry], which: int) -> dict[str, list[int]]:
    """Word to the coded (template, offset) of each template whose rarest (0) or second (1) word it is."""
    out: dict[str, list[int]] = defaultdict(list)
    for k, e in enumerate(index):
        out[e.tokens[e.rare[which]]].append(_code(k, -e.rare[which]))
    return dict(out)


#: A place is one long: the template's number times this, plus its start. Adding a word's position
#: to a posting's code gives the place, so equal places of two words are equal longs.
_SPAN = 1 << 40


def _code(number: int, start: int) -> int:
    return number * _SPAN + start


def _places(words: Column, index: list[Entry]) -> Column:
    """Coded places of all templates in a bound array of words."""
    tables = [postings(index, which) for which in (0, 1)]
    vocabulary = sorted(set(tables[0]) | set(tables[1]))
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(vocabulary), i)), lambda i: i.isNotNull())

    def proposed(positions: Column, table: dict[str, list[int]]) -> Column:
        listed = F.create_map(*[x for w, codes in sorted(table.items()) for x in (F.lit(w), F.array(*[F.lit(c).cast("long") for c in codes]))])
        of = lambda i: F.coalesce(F.try_element_at(listed, F.get(words, i)), F.array().cast("array<long>"))
        return F.flatten(F.transform(positions, lambda i: F.transform(of(i), lambda c: c + i)))

    both = let(at, lambda p: F.array_intersect(proposed(p, tables[0]), proposed(p, tables[1])))
    number = lambda c: F.floor((c + F.lit(_SPAN // 2)) / F.lit(_SPAN)).cast("int")
    facts = F.array(*[F.struct(F.array(*map(F.lit, e.tokens)).alias("words"), F.lit(e.key_at).alias("at"), F.lit(len(e.template.key.split())).alias("n"), F.lit(math.ceil(e.template.share * len(e.tokens))).alias("least")) for e in index])

    def stands(fact: Column, start: Column) -> Column:
        own = lambda at, n: F.slice(words, (start + at + 1).cast("int"), n)
        agree = F.zip_with(own(F.lit(0), F.size(fact["words"])), fact["words"], lambda a, b: a.eqNullSafe(b))
        inside = (start >= 0) & (start + F.size(fact["words"]) <= F.size(words))
        exact = own(fact["at"], fact["n"]) == F.slice(fact["words"], fact["at"] + 1, fact["n"])
        return F.when(inside, exact & (F.size(F.filter(agree, lambda same: same)) >= fact["least"])).otherwise(False)

    good = lambda c: let(number(c), lambda k: stands(F.get(facts, k), c - k.cast("long") * F.lit(_SPAN)))
    split = lambda c: let(number(c), lambda k: F.struct(k.alias("number"), (c - k.cast("long") * F.lit(_SPAN)).cast("int").alias("start")))
    return F.transform(F.array_sort(F.filter(both, good)), split)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row: ``<id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score, places``.

    ``places`` is ``array<struct<label,base,start,length>>`` by template and start, words counted
    from 0. ``score`` is the best placed template's idf against the largest idf of all, halved for
    short base phrases, 0 without a place. Null and empty texts have no words and no places; every
    row is answered by itself, so rows that repeat an id repeat their answer; a null id stays null; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    index = entries(templates)
    # only A-Z are lowered: of other letters, two lower to ASCII ones and are kept from it here
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ufffd")), F.lit("\u0130"), F.lit("\ufffd")))
    parts = F.split(text, SEPARATORS, -1)
    blank = lambda k: F.when(F.element_at("_parts", k) == "", 1).otherwise(0)
    n_words = F.greatest(F.size("_parts") - blank(1) - F.when(F.size("_parts") > 1, blank(-1)).otherwise(0), F.lit(0))
    words = F.slice(F.col("_parts"), F.lit(1) + blank(1), F.col("_n"))
    most = max(e.idf for e in index)
    facts = F.array(*[F.struct(F.lit(e.template.label).alias("label"), F.lit(e.template.base).alias("base"), F.lit(len(e.tokens)).alias("length"), F.lit(e.idf / most * (0.5 if e.template.base else 1.0)).alias("weight")) for e in index])
    fact = lambda x: F.get(F.col("_facts"), x["number"])
    base = F.filter("places", lambda x: x["base"])
    joined = lambda items: F.array_join(F.array_sort(F.array_distinct(F.transform(items, lambda x: x["label"]))), ",")
    return (
        docs.select(F.col(id_col).alias("_id"), parts.alias("_parts"))
        .withColumn("_n", n_words)
        .withColumn("_hits", let(words, lambda w: _places(w, index)))
        .withColumn("_facts", facts)
        .select(
            F.col("_id").alias(id_col),
            F.col("_n").cast("long").alias("n_words"),
            F.transform("_hits", lambda x: F.struct(fact(x)["label"].alias("label"), fact(x)["base"].alias("base"), x["start"].cast("long").alias("start"), fact(x)["length"].alias("length"))).alias("places"),
            F.coalesce(F.array_max(F.transform("_hits", lambda x: fact(x)["weight"])), F.lit(0.0)).alias("score"),
        )
        .select(
            id_col,
            "n_words",
            F.size(base).cast("long").alias("n_base"),
            F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
            F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.col("places")).alias("labels"),
            "score",
            "places",
        )
    )
