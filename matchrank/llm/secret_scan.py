"""Secrets: an Aho-Corasick pass over keywords, regular expressions anchored at the hits, checksums.

One automaton pass over the ASCII-lowered text finds every keyword; a kind's expression is tried
only where one of its keywords begins. Runs of hexadecimal digits have no keyword and are found by
their own expression. Token formats that embed a CRC-32 are reported only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from matchrank.llm.arrow import per_document, text_rows

# fixed values: kinds in order of report, their keywords, expressions and least lengths
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CHECKED = re.compile(r"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "checked",
    "gho_": "checked",
    "ghu_": "checked",
    "ghs_": "checked",
    "ghr_": "checked",
    "npm_": "checked",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*BASE, "checked"))}


def crc_suffix(body: str) -> str:
    """The six base-62 digits of the CRC-32 that such tokens end with."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits


class Scanner:
    def __init__(self):
        import ahocorasick

        self._auto = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self._auto.add_word(word, (len(word), kind))
        self._auto.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, str]]:
        """Spans ``(start, end, kind)`` in code points, end exclusive, by start, then kind."""
        lowered = text.lower() if text.isascii() else text.encode().lower().decode()  # bytes lower A-Z only
        hits: dict[str, set[int]] = {}
        for last, (size, kind) in self._auto.iter(lowered):
            hits.setdefault(kind, set()).add(last - size + 1)
        out = []
        for kind, rx in (("assign", ASSIGN), ("access", ACCESS), ("checked", CHECKED)):
            free = 0  # a match, kept or not, blocks what begins inside it
            for at in sorted(hits.get(kind, ())):
                if at < free or not (m := rx.match(text, at)):
                    continue
                free = m.end()
                good = {
                    "assign": lambda m: len(m[2]) >= 12,
                    "access": lambda m: m.end() - m.start() >= 18,
                    "checked": lambda m: crc_suffix(m[2]) == m[3],
                }[kind](m)
                if good:
                    out.append((m.start(), m.end(), kind))
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked``.

    ``base_sha256`` digests the spans of the first three kinds, ``spans`` lists all. Null and empty
    texts have no spans. Rows are independent: repeated ids give repeated rows, an empty table gives
    none, other columns are ignored.
    """
    names = [f"n_{k}" for k in BASE]
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in names], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_checked", pa.int64())])
    listed = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)

    def make():
        scan = scanner().scan

        def work(ids: list, texts: list[str]) -> dict:
            found = [scan(t) for t in texts]
            base = [listed(x for x in f if x[2] in BASE) for f in found]
            return {
                "doc_id": ids,
                **{f"n_{k}": [sum(x[2] == k for x in f) for f in found] for k in ORDER},
                "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base],
                "spans": [listed(f) for f in found],
            }

        return work

    return per_document(text_rows(docs, id_col, text_col), make, schema, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string, n_checked long")
