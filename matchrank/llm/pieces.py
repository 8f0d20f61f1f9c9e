"""SentencePiece encoding and decoding through a table of distinct marked words.

The library escapes each space as the mark U+2581 and puts one in front of the text. If no piece
holds a mark behind another character, no merge crosses the boundary before a mark, so a text is
the concatenation of chunks ``marks + rest`` that segment independently. For each run of documents
(a few megabytes of text) the distinct chunks form a table; the table is segmented once, in one
call, and its ids are joined back to the chunks' positions. A table over a whole corpus has no size
bound to broadcast, and joining every occurrence to it would shuffle all texts.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchrank.llm.arrow import per_document, text_rows

MARK = "▁"
#: Documents per table at most; their texts are also bounded in bytes (``arrow.slices``).
RUN_ROWS = 4096


class PieceCodec:
    """Encode to ids and decode, exactly as the library does without sampling or added ids."""

    def __init__(self, path: str):
        import sentencepiece

        self._lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._lib.id_to_piece(i) for i in range(self._lib.get_piece_size())]
        # the table is exact only if pieces respect marks and the library changes nothing else
        probe = "a  bÄﬁİ\t\n c "
        self._split = (
            not any(MARK in p.lstrip(MARK) for p in pieces)
            and self._lib.decode(self._lib.encode(probe)) == probe
            and self._lib.encode("a", out_type=str)[0].startswith(MARK)
        )
        self._find = re.compile(f"{MARK}+[^{MARK}]*").findall
        self._mark_id = self._lib.piece_to_id(MARK)

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of chunks; a lone mark is a piece, which the library would drop as an empty text."""
        found = self._lib.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        return [[self._mark_id] if c == MARK else x for c, x in zip(chunks, found, strict=True)]

    def encode_run(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Of each text its ids, and the same in decimal joined by commas."""
        if not self._split:
            return [(np.array(x, np.int32), ",".join(map(str, x))) for x in self._lib.encode(texts, num_threads=1)]
        distinct: dict[str, int] = {}
        places = [np.fromiter((distinct.setdefault(c, len(distinct)) for c in self._find(MARK + t.replace(" ", MARK))) if t else (), np.int64) for t in texts]
        table = self.segment(list(distinct))
        decimal = [",".join(map(str, x)) for x in table]
        ids = pa.array(table, pa.list_(pa.int32()))
        return [(ids.take(pa.array(at)).flatten().to_numpy(), ",".join([decimal[k] for k in at.tolist()])) for at in places]

    def decode(self, ids: np.ndarray) -> str:
        return self._lib.decode(ids.tolist()) if len(ids) else ""


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec per worker process and model."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked, ``ids`` and ``decoded``.

    Null or empty text has no ids and decodes to the empty text. Rows are independent: repeated ids
    give repeated rows, an empty table gives none, other columns are ignored. ``model_path`` must
    lead to the same file on every worker.
    """
    schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        kind += ", ids array<int>, decoded string"

    def make():
        c = codec(model_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def work(ids: list, texts: list[str]) -> dict:
            out: dict[str, list] = {name: [] for name, _ in schema}
            out["doc_id"] = ids
            for coded, decimal in c.encode_run(texts):
                back = c.decode(coded)
                row = {"n_tokens": len(coded), "ids_sha256": sha(decimal), "decoded_sha256": sha(back)}
                for name, value in (row | ({"ids": coded, "decoded": back} if with_ids else {})).items():
                    out[name].append(value)
            return out

        return work

    return per_document(text_rows(docs, id_col, text_col), make, pa.schema(schema), kind, rows=RUN_ROWS)
