"""Packing along a space-filling curve.

Each document's hashed vector of four-byte grams is projected, by signs that the hash gives, to a few
dimensions; the direction of that vector, quantized, gets a Hilbert key. The curve is cut into stretches of about equal
bytes (a cell that a third of all rows shares is dealt over several), documents are sorted by key, then id, inside
their stretch, encoded in that order, and laid end to end; the line is cut every ``length`` ids. Neighbours on the curve share sequences and only the
very last sequence needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchrank.llm import bytebpe
from matchrank.llm.arrow import slices, text_rows
from matchrank.llm.storage import materialize, small_batches

DIMS, BITS = 4, 12
#: Leading bits of a key that name the cell whose bytes are counted.
COARSE = 16
#: Odd multiplier of the gram hash; its product's top bits are the signs of a gram.
_MULTIPLIER = np.uint32(2654435761)
#: Sign of dimension d in a histogram bin: bit d of the bin's number.
_SIGNS = np.array([[1 if k >> d & 1 else -1 for d in range(DIMS)] for k in range(1 << DIMS)], np.int64)


def project(texts: list[str]) -> np.ndarray:
    """Signed projections of the texts' gram counts, one row each; all bytes count."""
    out = np.zeros((len(texts), DIMS))
    for k, t in enumerate(texts):
        raw = t.encode()
        bins = np.zeros(1 << DIMS, np.int64)
        for at in range(4):
            n = (len(raw) - at) // 4
            if n > 0:
                grams = np.frombuffer(raw, "<u4", n, at) * _MULTIPLIER
                bins += np.bincount(grams >> np.uint32(32 - DIMS), minlength=1 << DIMS)
        out[k] = bins @ _SIGNS
    return out


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of cells, ``x`` being their integer coordinates, one row each.

    Gray-code transform of the coordinates from the highest bit down, then their bits interleaved;
    neighbouring indices are neighbouring cells.
    """
    x = x.T.copy()
    dims, n = x.shape
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> b) & 1, flip ^ ((1 << b) - 1), flip)
    x ^= flip
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def hilbert_keys(vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each vector's direction, quantized to ``bits`` bits per dimension."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    return hilbert_index(np.clip(((unit + 1) / 2 * ((1 << bits) - 1)).round().astype(np.int64), 0, (1 << bits) - 1), bits)


@dataclass(frozen=True)
class Stretches:
    """Where the curve is cut: per counted cell its first stretch and over how many it is dealt."""

    cells: np.ndarray
    first: np.ndarray
    several: np.ndarray

    @property
    def count(self) -> int:
        return int((self.first + self.several).max(initial=1))

    def of(self, keys: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        """The stretch of each row; rows of a cell that is dealt go by a checksum of text and id."""
        at = np.searchsorted(self.cells, keys >> (DIMS * BITS - COARSE))
        out = self.first[at]
        for k in np.flatnonzero(self.several[at] > 1):
            mark = zlib.crc32(part.column(1)[k].as_py().encode(), zlib.crc32(str(part.column(0)[k].as_py()).encode()))
            out[k] += mark % self.several[at[k]]
        return out


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: Stretches | None = None) -> DataFrame:
    """``doc_id, text, curve_key`` and, if the curve is cut, ``stretch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys = hilbert_keys(project(part.column(1).to_pylist()))
                columns = {"doc_id": part.column(0), "text": part.column(1), "curve_key": pa.array(keys)}
                yield pa.RecordBatch.from_pydict(columns | ({"stretch": pa.array(cut.of(keys, part), pa.int32())} if cut else {}))

    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, text string, curve_key long" + (", stretch int" if cut else ""))


def stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smallest: int = 1 << 24, largest: int = 1 << 28, most: int = 4096) -> Stretches:
    """Cuts of the curve into stretches of about equal bytes of text.

    Bytes are summed over the curve's first ``2 ** COARSE`` cells, the only list that the driver
    sees, and cut in order. There are about ``most`` stretches unless they would hold less than
    ``smallest`` or more than ``largest`` bytes; a cell with more than a stretch's share is dealt over several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                sizes = pc.add(pc.binary_length(part.column(1)), 64).cast(pa.int64())
                yield pa.RecordBatch.from_pydict({"cell": pa.array(hilbert_keys(project(texts)) >> (DIMS * BITS - COARSE)), "n": sizes})

    counted = text_rows(docs, id_col, text_col).mapInArrow(run, "cell long, n long")
    sizes = counted.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas()
    n = sizes["n"].to_numpy(np.int64)
    share = min(max(int(n.sum()) // most, smallest), largest)
    first, several, at, held = [], [], 0, 0
    for size in n.tolist():
        if held and held + size > share:
            at, held = at + 1, 0
        first.append(at)
        several.append(-(-size // share))
        if several[-1] > 1:
            at, held = at + several[-1], 0
        else:
            held += size
    return Stretches(sizes["cell"].to_numpy(np.int64), np.array(first, np.int64), np.array(several, np.int64))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **cut: int) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids.

    Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked,
    ``ids``. Every document ends with ``end_id``, so null and empty texts make one id. Each row is a
    document of its own, also where ids repeat (give such rows distinct ids to tell their pieces
    apart); null ids stay null; rows with one key
    follow each other by id. ``cut`` has the limits of ``stretches``. An empty table has no pieces; other columns are ignored.
    """
    curve = stretches(docs, id_col, text_col, **cut)
    ordered = with_keys(docs, id_col, text_col, curve).repartitionById(curve.count, F.col("stretch")).sortWithinPartitions("curve_key", "doc_id").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part, at = bytebpe.encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], bpe.dtype).tobytes()
        for batch in batches:
            for some in slices(batch):
                ids = [bpe.encode(t) + end for t in some.column(1).to_pylist()]
                sizes = np.array([len(b) // bpe.dtype.itemsize for b in ids], np.int64)
                begins = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(ids), part, np.int64)), pa.array(begins), pa.array(sizes), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "begins", "doc_tokens", "ids"],
                )

    with small_batches(docs.sparkSession):
        coded = materialize(ordered.mapInArrow(encode, "doc_id long, part long, begins long, doc_tokens long, ids binary"), "packing-ids")
    # a row per stretch of the curve, of which each holds 16 MB or more: short enough to broadcast beside any input
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = coded.groupBy("part").agg(F.sum("doc_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    placed = coded.join(F.broadcast(totals), "part").select("doc_id", "doc_tokens", (F.col("base") + F.col("begins")).alias("at"), "ids")

    schema = [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if with_ids:
        schema, kind = [*schema, ("ids", pa.list_(pa.int64()))], kind + ", ids array<long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = bytebpe.encoder(tokenizer_path).dtype
        for batch in batches:
            for some in slices(batch, 3):
                rows: list[tuple] = []
                for doc_id, total, at, raw in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    ids = np.frombuffer(raw, dtype).astype("<u4")
                    start = 0
                    while start < total:
                        sequence, offset = divmod(at + start, length)
                        size = min(length - offset, total - start)
                        piece = ids[start : start + size]
                        rows.append((doc_id, start, size, zlib.crc32(piece.tobytes()), total, sequence, offset, *([piece.astype(np.int64)] if with_ids else [])))
                        start += size
                columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, schema, strict=True)], schema=pa.schema(schema))

    return placed.mapInArrow(cut, kind)
