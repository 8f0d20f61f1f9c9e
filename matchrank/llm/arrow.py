"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows handled at once inside a batch, and their bytes of text, so that a run of long texts stays
#: small in memory; a longer text is handled alone.
STEP, STEP_BYTES = 256, 1 << 22


def slices(batch: pa.RecordBatch, text: int = 1, rows: int = STEP, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in order, in slices of at most ``rows`` rows and about ``size`` bytes of column ``text``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        most = max(1, int(np.searchsorted(ends, done + size, "right")) - at)
        yield batch.slice(at, min(rows, most))
        at += min(rows, most)


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just id and text under fixed names, null text as empty: what the Arrow operators read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def per_document(docs: DataFrame, make: Callable[[], Callable[[list, list[str]], dict]], schema: pa.Schema, spark_schema: str, rows: int = STEP) -> DataFrame:
    """Map slices of (ids, texts) to columns; ``make`` builds the function once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, rows=rows):
                columns = work(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return docs.mapInArrow(run, spark_schema)
