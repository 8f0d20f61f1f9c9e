"""TF-IDF vectors of long texts in little space: documents in blocks, a block's counts as packed numbers.

A block holds the documents of a task up to ``OCCURRENCES`` features. It has a list of its different features, cut into
ranges of the hash, and its documents' features as places in that list. The lists meet by range, where a feature's
documents are counted over all blocks; the counts return to their block as a number per feature. So a document's
entries move once, in under two bytes each, and a feature's hash once per block.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type
from pyspark.sql.types import DataType

from matchrank.operators.lineage import cut

#: Features, counted as often as they come, from which a block is closed.
OCCURRENCES = 1 << 21
#: Bytes of input, as estimated, for one range of hashes, and the most ranges, as a power of two. Results don't depend on either.
_RANGE_BYTES, _MOST_BITS = 6 << 20, 14
_HEAD = struct.Struct("<QBQ")


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 as planes of bytes, compressed: the upper planes of small numbers take next to nothing."""
    x = np.ascontiguousarray(x, "<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    body = pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if planes.size else b""
    return _HEAD.pack(len(x), width, len(body)) + body


def unpack(body: bytes) -> list[np.ndarray]:
    """The arrays of a row of ``pack``."""
    out, at = [], 0
    while at < len(body):
        n, width, size = _HEAD.unpack_from(body, at)
        at += _HEAD.size
        x = np.zeros((n, 8), np.uint8)
        if width and n:
            x[:, :width] = np.frombuffer(pa.decompress(body[at : at + size], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
        out.append(x.reshape(-1).view("<u8"))
        at += size
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as the first and the differences; ``np.cumsum`` undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def _steps_by_row(x: np.ndarray, per: np.ndarray) -> np.ndarray:
    """``_steps`` of each row of ``per`` entries."""
    steps, first = _steps(x), (np.cumsum(per) - per)[per > 0]
    steps[first] = x[first]
    return steps


def _from_steps_by_row(steps: np.ndarray, per: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(steps.astype(np.int64))])
    return total[1:] - np.repeat(total[np.cumsum(per) - per], per)


def _groups(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]]))


def _lists(kinds: dict[str, DataType]) -> str:
    return ", ".join(f"{k} array<{t.simpleString()}>" for k, t in kinds.items())


def _blocks(docs: DataFrame, key: str, features: Column, asking: bool, kinds: dict[str, DataType], bits: int, most: int) -> DataFrame:
    """``g, block, <ids of either side>, body``: a row per block, where ``g`` is -1 - ``block``, with its documents' ids and counts,
    and a row per block and range of hashes, where ``g`` is the range, with the features there and their numbers of documents."""
    rows = docs.select(key, F.transform(features, lambda x: F.xxhash64(x)).alias("h"))
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def closed(number: int, ids: list[pa.Array], sizes: list[np.ndarray], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names, size, h = pa.concat_arrays(ids), np.concatenate(sizes), np.concatenate(hashes).view(np.uint64)
        if not len(h):
            return
        order = np.argsort(h)
        h = h[order]
        first = _groups(h)
        known, place = h[first], np.empty(len(h), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        del h, order
        place += np.repeat(np.arange(len(size)), size) * len(known)
        place.sort()
        first, entries = _groups(place), place
        tf = np.diff(np.append(first, len(entries)))
        row, place = np.divmod(entries[first], len(known))
        per, df = np.bincount(row, minlength=len(size)), np.bincount(place)
        ends = np.append(np.searchsorted(known, edges), len(known))
        used = np.flatnonzero(np.diff(ends))
        block = 2 * ((TaskContext.get().partitionId() << 24) + number) + asking
        bodies = [pack(per) + pack(_steps_by_row(place, per)) + pack(tf - 1)]
        bodies += [pack(_steps(known[a:b])) + pack(df[a:b] - 1) for a, b in zip(ends[used], ends[used + 1], strict=True)]
        ends = pa.array(np.append(0, np.full(len(bodies), len(names))), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, names) if k == key else pa.nulls(len(bodies), pa.list_(pa_type(t))) for k, t in kinds.items()]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1 - block, used)), pa.array(np.full(len(bodies), block)), *lists, pa.array(bodies, pa.binary())], ["g", "block", *kinds, "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, sizes, hashes = 0, 0, [], [], []
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                h = b.column("h")
                ids.append(b.column(key))
                sizes.append(pc.fill_null(pc.list_value_length(h), 0).to_numpy(zero_copy_only=False))
                hashes.append(np.array(h.flatten()))  # a copy, as a view would hold the whole batch
                held += len(hashes[-1])
                if held >= most:
                    yield from closed(number, ids, sizes, hashes)
                    number, held, ids, sizes, hashes = number + 1, 0, [], [], []
        if ids:
            yield from closed(number, ids, sizes, hashes)

    return rows.mapInArrow(run, f"g long, block long, {_lists(kinds)}, body binary")


def packed_vectors(queries: DataFrame, items: DataFrame, features: Column, min_df: int = 2, most: int = OCCURRENCES) -> tuple[DataFrame, int]:
    """``block, query_id, item_id, n, body``, written, and the number of documents: a row per block of queries (odd ``block``) or items, with the list of its ids,
    the number of its entries and what ``vectors`` reads. The space is fitted on both sides; norms are over all
    its features, entries are of those that a query has. Ids must be unique on their side."""
    kinds = {k: d.schema[k].dataType for k, d in (("query_id", queries), ("item_id", items))}
    total = queries.count() + items.count()
    size = items._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    bits = min(max(4, math.ceil(math.log2(max(size, 1) / _RANGE_BYTES))), _MOST_BITS)
    every = _blocks(items, "item_id", features, False, kinds, bits, most).unionByName(_blocks(queries, "query_id", features, True, kinds, bits, most // 4))
    # both reads below are of one shuffle; a plain filter, or fewer columns, would be pushed below it and make two
    dealt = every.repartition("g")
    here = F.when(F.spark_partition_id() >= 0, F.col("g"))

    def meet(t: pa.Table) -> pa.Table:
        """The documents of each feature of a range over all blocks, for each block: twice their number, and one more if a query
        has the feature; 0 for those of less than ``min_df``."""
        found = [unpack(b.as_py()) for b in t.column("body")]
        block = t.column("block").to_numpy()
        sizes = [len(df) for _, df in found]
        hashes = np.concatenate([np.cumsum(steps) for steps, _ in found])
        order = np.argsort(hashes)
        first = _groups(hashes[order])
        df = np.add.reduceat(np.concatenate([df for _, df in found])[order] + np.uint64(1), first)
        asked = np.maximum.reduceat(np.repeat(block % 2, sizes)[order], first).astype(np.uint64)
        value = np.empty(len(hashes), np.uint64)
        value[order] = np.repeat(np.where(df >= min_df, 2 * df + asked, 0).astype(np.uint64), np.diff(np.append(first, len(hashes))))
        ends, bodies = np.cumsum([0, *sizes]), []
        for a, b in zip(ends, ends[1:], strict=False):
            v = value[a:b]
            bodies.append(pack(v) + pack(_steps(hashes[a:b][v % 2 == 1])))
        return pa.table({"g": -1 - block, "range": t.column("g"), "body": pa.array(bodies, pa.binary())})

    kind = f"block long, {_lists(kinds)}, n long, body binary"
    empty = pa.schema([("block", pa.int64()), *[(k, pa.list_(pa_type(t))) for k, t in kinds.items()], ("n", pa.int64()), ("body", pa.binary())]).empty_table()

    def settle(block: pa.Table, counts: pa.Table) -> pa.Table:
        if not block.num_rows:
            return empty
        found = [unpack(b.as_py()) for b in counts.sort_by("range").column("body")]
        value = np.concatenate([v for v, _ in found])
        known = np.concatenate([np.cumsum(steps) for _, steps in found])
        per, steps, tf = unpack(block.column("body")[0].as_py())
        per = per.astype(np.int64)
        row, place = np.repeat(np.arange(len(per)), per), _from_steps_by_row(steps, per)
        v = value[place]
        w = (1 + np.log(tf + 1.0)) * (np.log((1.0 + total) / (1.0 + v // 2)) + 1)
        norm = np.sqrt(np.bincount(row[v > 0], (w * w)[v > 0], len(per)))
        asked = v % 2 == 1
        per = np.bincount(row[asked], minlength=len(per))
        kept = np.flatnonzero(per)
        if not len(kept):
            return empty
        place = (np.cumsum(value % 2).astype(np.int64) - 1)[place[asked]]
        body = pack(_steps(known)) + pack(value[value % 2 == 1] // 2) + pack(per[kept]) + pack(_steps_by_row(place, per)) + pack(tf[asked]) + pack(norm[kept].view(np.uint64))
        ids = []
        for k, t in kinds.items():
            names = block.column(k)[0]
            names = names.values.take(pa.array(kept)) if names.is_valid else None
            ids.append(pa.nulls(1, pa.list_(pa_type(t))) if names is None else pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names))
        return pa.table([block.column("block").slice(0, 1), *ids, pa.array([int(asked.sum())]), pa.array([body], pa.binary())], names=["block", *kinds, "n", "body"])

    counts = dealt.where(here >= 0).groupBy("g").applyInArrow(meet, "g long, range long, body binary")
    return cut(dealt.where(here < 0).groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(settle, kind)), total


def vectors(body: bytes, total: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's hashes in order and its entries by document: row, place among the hashes, weight. Item weights lack their
    feature's idf, which query weights (those with a ``total`` of documents) have twice."""
    steps, df, per, places, tf, norm = unpack(body)
    per = per.astype(np.int64)
    row, place = np.repeat(np.arange(len(per)), per), _from_steps_by_row(places, per)
    w = (1 + np.log(tf + 1.0)) / norm.view(np.float64)[row]
    if total is not None:
        w *= ((np.log((1.0 + total) / (1.0 + df)) + 1) ** 2)[place]
    return np.cumsum(steps), row, place, w
