"""Fill-in-the-middle: texts cut at two unit borders and written in another order around sentinels.

A unit is a match of an expression. The cut is found in two passes of a lazy match iterator: the first
counts units, the second advances to the two ranks and reads where those matches end. No list of
units is ever held, so beside the text the memory is constant, whatever the number of units.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchrank.llm.arrow import per_document

#: Lines with their line break; a last line may lack it.
LINES = r"[^\n]*\n|[^\n]+"
#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must be told apart wherever they stand: none is empty, holds another or begins as one ends."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (i != j and a in b) or any(a[:k] == b[-k:] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"ambiguous sentinels: {sentinels}")


def count_units(matches: Iterator[re.Match]) -> int:
    """First pass: how many matches there are."""
    return sum(1 for _ in matches)


def unit_ends(matches: Iterator[re.Match], first: int, second: int) -> tuple[int, int]:
    """Second pass: where the ``first``-th and the ``second``-th match end, 0 for rank 0; reads no further."""

    def advance(by: int, end: int) -> int:
        last = deque(islice(matches, by), maxlen=1)
        return last[0].end() if last else end

    a = advance(first, 0)
    return a, advance(second - first, a)


def key_numbers(seed: int | str, key: object) -> list[int]:
    """Four 32-bit numbers from the SHA-256 of ``seed:key``; a null key is the empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int | str = 7, percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row: ``<id_col>, n, form, prefix_chars, middle_chars, output``.

    A row's numbers h1..h4 come from its id (``key_numbers``). With n units, the prefix ends after the
    smaller and the middle after the larger of ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units. ``form`` is
    ``plain`` for an empty text, one that holds a sentinel and where ``h3 % 100 >= percent``; else ``spm``
    where ``h4 % 100 < spm_percent``, or ``psm``. Null text counts as empty. Rows are independent:
    repeated ids are cut alike, a null id has the empty key, texts of any length are cut whole, an
    empty table gives no rows, other columns are ignored, whatever their names. ``unit`` must not
    match the empty text; what no unit covers belongs to the part that the next unit is in.
    """
    check_sentinels(sentinels)
    if re.compile(unit).match(""):
        raise ValueError("a unit must not be empty")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    if id_type is None:
        raise TypeError(f"ids of type {kind}")
    schema = pa.schema([("_id", id_type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def make():
        find = re.compile(unit).finditer
        before_prefix, before_suffix, before_middle = sentinels

        def one(key: object, text: str) -> tuple:
            h1, h2, h3, h4 = key_numbers(seed, key)
            n = count_units(find(text))
            if not text or any(s in text for s in sentinels) or h3 % 100 >= percent:
                return n, "plain", None, None, text
            a, b = unit_ends(find(text), *sorted((h1 % (n + 1), h2 % (n + 1))))
            if h4 % 100 < spm_percent:
                return n, "spm", a, b - a, "".join((before_suffix, text[b:], before_prefix, text[:a], before_middle, text[a:b]))
            return n, "psm", a, b - a, "".join((before_prefix, text[:a], before_suffix, text[b:], before_middle, text[a:b]))

        def work(ids: list, texts: list[str]) -> dict:
            made = [one(*row) for row in zip(ids, texts, strict=True)]
            return {"_id": ids} | {name: [m[k] for m in made] for k, name in enumerate(schema.names[1:])}

        return work

    out = per_document(rows, make, schema, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``transform`` was given, from its output and form alone."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    text = lambda *order: F.concat(*[parts[k] for k in order])
    return F.when(form == "psm", text(1, 3, 2)).when(form == "spm", text(2, 3, 1)).otherwise(output)
