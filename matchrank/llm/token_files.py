"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A file holds a run of documents in ascending id order::

    frame*        each an independent zstandard frame with content size and checksum; its content is
                  little-endian unsigned 32-bit ids of whole documents, or one part of a long one
    index frame   skippable (0x184D2A50): zstandard-compressed u64 count, i64 ids[], u64 lengths[]
    seek table    skippable (0x184D2A5E), as in the public seekable format: per frame the compressed
                  size, the content size and the low 32 bits of the content's XXH64; then the frame
                  count, a descriptor byte (bit 7: checksums) and the magic number 0x8F92EAB1

A reader takes the last bytes, then the table and the index, then only the frames it needs.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchrank.llm import bytebpe
from matchrank.llm.arrow import slices, text_rows
from matchrank.llm.storage import fresh_dir, materialize, small_batches

INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 18


class Writer:
    """Writes one file; documents must come in ascending id order."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self._out, self._most = out, frame_bytes
        self._zip = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self._parts: list[bytes] = []
        self._held = 0
        self._table: list[tuple[int, int, int]] = []
        self._ids: list[int] = []
        self._lengths: list[int] = []

    def _frame(self, content: bytes) -> None:
        packed = self._zip.compress(content)
        self._out.write(packed)
        self._table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self._held:
            content = b"".join(self._parts)
            for at in range(0, len(content), self._most):  # one long document spans several frames
                self._frame(content[at : at + self._most])
        self._parts, self._held = [], 0

    def add(self, doc_id: int, ids: bytes) -> None:
        """A document's ids as little-endian u32 bytes."""
        if self._held and self._held + len(ids) > self._most:
            self._flush()
        self._parts.append(ids)
        self._held += len(ids)
        self._ids.append(doc_id)
        self._lengths.append(len(ids) // 4)

    def close(self) -> tuple[int, int]:
        """Write index and table; returns the numbers of documents and ids."""
        self._flush()
        n = len(self._ids)
        index = self._zip.compress(struct.pack("<Q", n) + np.array(self._ids, "<i8").tobytes() + np.array(self._lengths, "<u8").tobytes())
        self._out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self._table.append((8 + len(index), 0, 0))
        rows = b"".join(struct.pack("<III", *row) for row in self._table)
        self._out.write(struct.pack("<II", TABLE_MAGIC, len(rows) + 9) + rows + struct.pack("<IBI", len(self._table), 0x80, SEEK_MAGIC))
        return n, int(sum(self._lengths))


class Reader:
    """Random access to one file through a seekable binary file."""

    def __init__(self, file):
        self._file, self._zip = file, zstandard.ZstdDecompressor()
        size = file.seek(0, 2)
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("not a seekable token file")
        file.seek(size - 9 - 12 * count)
        table = np.frombuffer(file.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self._sizes, self._content, self._sums = table[:-1, 0], table[:-1, 1], table[:-1, 2]
        self._at = np.concatenate([[0], np.cumsum(self._sizes)])
        self._begins = np.concatenate([[0], np.cumsum(self._content)])
        file.seek(int(self._at[-1]) + 8)
        index = self._zip.decompress(file.read(int(table[-1, 0]) - 8))
        n = struct.unpack_from("<Q", index)[0]
        self.doc_ids = np.frombuffer(index, "<i8", n, 8)
        self.lengths = np.frombuffer(index, "<u8", n, 8 + 8 * n).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        """The content of frame ``k``, checked against its sum."""
        if self._last[0] != k:
            self._file.seek(int(self._at[k]))
            content = self._zip.decompress(self._file.read(int(self._sizes[k])))
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self._sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self._last = (k, content)
        return self._last[1]

    def ids(self, position: int) -> bytes:
        """The ids of the document at a position in the file, as u32 bytes."""
        a, b = 4 * int(self.starts[position]), 4 * int(self.starts[position + 1])
        k = int(np.searchsorted(self._begins, a, "right")) - 1
        out = []
        while a < b:
            content, base = self.frame(k), int(self._begins[k])
            out.append(content[a - base : b - base])
            a = base + len(content)
            k += 1
        return b"".join(out)

    def find(self, doc_id: int) -> list[int]:
        """Positions of a document id; several where the id repeats."""
        lo, hi = np.searchsorted(self.doc_ids, doc_id, "left"), np.searchsorted(self.doc_ids, doc_id, "right")
        return list(range(int(lo), int(hi)))


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", docs_per_file: int = 8192, folder: str | None = None) -> DataFrame:
    """Encode texts, append ``end_id`` to each, write files; returns the manifest.

    Manifest: ``file, file_no, n_docs, n_ids, first_start`` with ``first_start`` the ids before the
    file in ascending id order (then text hash, where ids repeat). The manifest is itself written to
    the shared folder, so a lost executor never makes it name a file of an abandoned attempt: each
    attempt writes under a name of its own. Null text counts as empty; null ids come first, as the
    least 64-bit integer. An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "token-files")
    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    count = docs.count()
    files = max(1, -(-count // docs_per_file))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = pa.schema([("file", pa.string()), ("file_no", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = bytebpe.encoder(tokenizer_path)
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        writer = None
        for batch in batches:
            for some in slices(batch):
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if writer is None:
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        writer = Writer(out)
                    writer.add(doc_id, np.frombuffer(bpe.encode(text), bpe.dtype).astype("<u4").tobytes() + end)
        if writer is not None:
            n, ids = writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((f"{folder}/{name}", part, n, ids), schema, strict=True)], schema=schema)

    with small_batches(spark):
        manifest = materialize(ordered.mapInArrow(run, "file string, file_no long, n_docs long, n_ids long"), "token-manifest")
    # one row per file: 8,192 documents or more become one row here
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))).repartition(files)


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read whole files back: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids``."""
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if with_ids:
        schema.append(("ids", pa.list_(pa.int64())))
        kind += ", ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as f:
                    reader = Reader(f)
                    for at in range(0, len(reader.doc_ids), 512):
                        span = range(at, min(at + 512, len(reader.doc_ids)))
                        ids = [reader.ids(p) for p in span]
                        columns = [reader.doc_ids[span.start : span.stop], first + reader.starts[span.start : span.stop], reader.lengths[span.start : span.stop], [zlib.crc32(b) for b in ids]]
                        if with_ids:
                            columns.append([np.frombuffer(b, "<u4").astype(np.int64) for b in ids])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], schema=pa.schema(schema))

    return manifest.select("file", "first_start").mapInArrow(run, kind)


def read_documents(file: str, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """Ids of a few documents of one file; only their frames are decompressed."""
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_file(path) as f:
        reader = Reader(f)
        return {d: [np.frombuffer(reader.ids(p), "<u4").tolist() for p in reader.find(d)] for d in doc_ids}
