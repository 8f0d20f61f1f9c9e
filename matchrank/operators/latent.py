"""An encoder that learns: truncated SVD of a fitted sparse space, by block power iteration.

Vectors lie in rows of sorted features; the factor, features x rank, is small: its size is checked before it
goes to the tasks. One pass multiplies each block of rows by the factor and by its own transpose, and
only sums per feature are shuffled. After each pass the factor is made orthonormal on the driver
(rank x rank Gram matrix and the factor itself, which is what is broadcast anyway).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchrank.operators.lineage import cut
from matchrank.operators.retrieval import gathered_vectors
from matchrank.sources.contracts import ContractError

#: Cells of the factor (features x rank) at most: 256 MB in doubles, on the driver and in each task.
MOST_CELLS = 1 << 25
_ROWS = 1024


@dataclass
class Latent:
    """The fitted factor: ``features`` in ascending order, ``components`` features x rank, orthonormal."""

    features: np.ndarray
    components: np.ndarray

    def encode(self, vectors: DataFrame, key: str) -> DataFrame:
        """``key, vector``: unit vectors of long-form vectors (``key, fid, w``) in the latent space; what has no
        known feature is the zero vector."""
        return self.encode_rows(gathered_vectors({"x": vectors}, key), key)

    def encode_rows(self, rows: DataFrame, key: str) -> DataFrame:
        """``encode`` of vectors that are gathered already (``key, x_f, x_w``)."""
        spark = rows.sparkSession
        names, factor = spark.sparkContext.broadcast(self.features), spark.sparkContext.broadcast(self.components)
        kind = rows.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                y = _projected(b, names.value, factor.value)[3]
                norm = np.linalg.norm(y, axis=1, keepdims=True)
                y = np.divide(y, norm, out=np.zeros_like(y), where=norm > 1e-12)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(key), lists], [key, "vector"])

        return rows.mapInArrow(run, f"{key} {kind}, vector array<double>")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``_ROWS`` rows: each entry of one is multiplied by a whole row of the factor in memory."""
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _projected(b: pa.RecordBatch, names: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and weight of each entry with a known feature, and rows x rank products."""
    f, w = b.column("x_f"), b.column("x_w")
    row = np.repeat(np.arange(b.num_rows), np.diff(f.offsets.to_numpy()))
    ids, values = f.flatten().to_numpy(), w.flatten().to_numpy()
    at = np.minimum(np.searchsorted(names, ids), max(len(names) - 1, 0))
    hit = names[at] == ids if len(names) else np.zeros(len(ids), bool)
    row, at, values = row[hit], at[hit], values[hit]
    y = np.zeros((b.num_rows, factor.shape[1]))
    np.add.at(y, row, factor[at] * values[:, None])
    return row, at, values, y


def fit(vectors: DataFrame, key: str, rank: int = 64, passes: int = 4, seed: int = 42) -> Latent:
    """The leading ``rank`` right singular vectors of long-form vectors (``key, fid, w``), after ``passes`` passes.

    A space of more than ``MOST_CELLS`` / rank features is an error: fit it with ``max_features``. Fewer
    features than ``rank`` give a factor of that many columns.
    """
    return fit_rows(cut(gathered_vectors({"x": vectors}, key)), rank, passes, seed)


def fit_rows(rows: DataFrame, rank: int = 64, passes: int = 4, seed: int = 42) -> Latent:
    """``fit`` of vectors that are gathered already (``x_f, x_w``, a written table); a column ``n`` says how many equal
    documents a row stands for."""
    spark = rows.sparkSession
    known = cut(rows.select(F.explode("x_f").alias("fid")).distinct())
    n = known.count()
    if n * rank > MOST_CELLS:
        raise ContractError(f"{n} features x rank {rank} are more than {MOST_CELLS} cells")
    names = np.sort(known.toArrow().column("fid").to_numpy())
    rows = rows.select("x_f", "x_w", F.col("n") if "n" in rows.columns else F.lit(1).cast("long").alias("n"))
    rank = min(rank, n)
    factor = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, rank)))[0] if n else np.zeros((0, rank))
    columns = [f"c{k}" for k in range(rank)]
    for _ in range(passes if n else 0):
        held, known = spark.sparkContext.broadcast(factor), spark.sparkContext.broadcast(names)

        def run(batches: Iterator[pa.RecordBatch], held=held, known=known) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                row, at, values, y = _projected(b, known.value, held.value)
                values = values * b.column("n").to_numpy()[row]
                used, place = np.unique(at, return_inverse=True)
                z = np.zeros((len(used), y.shape[1]))
                np.add.at(z, place, y[row] * values[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), *[pa.array(np.ascontiguousarray(z[:, k])) for k in range(z.shape[1])]], ["at", *columns])

        sums = rows.mapInArrow(run, "at long, " + ", ".join(f"{c} double" for c in columns)).groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        moved = np.zeros_like(factor)
        moved[sums.column("at").to_numpy()] = np.column_stack([sums.column(c).to_numpy() for c in columns])
        factor = np.linalg.qr(moved)[0]
    return Latent(names, factor)
