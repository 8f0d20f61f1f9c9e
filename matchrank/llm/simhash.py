"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two bits; the vector of their bit counts is its
embedding. The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, and the join runs on that lower bound: the segments form 9 blocks, and if the
Manhattan distance is at most 4, at most 4 blocks differ, so 5 blocks have equal counts throughout.
Each fingerprint stands in one grid cell per choice of 5 blocks (126 cells); candidates share a cell
and are then verified exactly. More blocks make cells more selective for larger corpora.

Only different fingerprints are joined: copies collapse before. A cell never gives pairs, only links:
each member with the least member that verified pairs of the cell lead to, at most one row a member.
Cells of up to ``HELD`` members are settled in memory; of a larger one (a family of thousands of near
copies, which no task should hold) each member stands at every fingerprint within 2 bits of itself,
two members share such a point if and only if they differ in 4 bits or fewer, and a point, which
never has more than 2,081 members, links them to its least one. Nothing is capped, no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchrank.llm import similar
from matchrank.llm.arrow import per_document, text_rows
from matchrank.llm.components import components
from matchrank.llm.storage import delete, materialize, path_of

DISTANCE = 4
#: Blocks of the grid; at 9 blocks 5 must agree.
BLOCKS = 9
SEGMENTS, SEGMENT_BITS = 32, 2
#: Members of a cell that are held together in memory; larger cells go by points.
HELD = 64
#: Fingerprints a task spreads over their cells.
PER_TASK = 16_384


def fingerprint(text: str, words: int, digest: Callable[[bytes, int], int]) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    parts = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return 0
    if len(parts) < words:
        hashes = np.array([digest(b" ".join(parts), 42)], "<u8")
    else:
        grams = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False))
        hashes = np.fromiter((digest(g, 42) for g in grams), "<u8", len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(some.view("u1").reshape(len(some), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the SimHash as a signed long, a row per row.

    Null and empty texts and texts without words give 0; texts of any length are hashed whole, in steps. Rows
    that repeat have equal prints, null ids stay null, an empty table stays empty, other columns are ignored.
    """

    def make():
        from xxhash import xxh64_intdigest

        signed = lambda v: v - (1 << 64) if v >> 63 else v
        return lambda ids, texts: {"doc_id": ids, "fp": [signed(fingerprint(t, words, xxh64_intdigest)) for t in texts]}

    rows = text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return per_document(rows, make, pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]), "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of all 32 segments, each in the place of its segment's two bits."""

    def half(at: int) -> Column:
        bits = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit(0xFFFFFFFF))
        return bits - F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(0x55555555))

    return F.shiftleft(half(32), 32).bitwiseOR(half(0))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def cell_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For each choice of ``blocks - distance`` blocks the bits of their segments."""
    edges = [round(k * SEGMENTS / blocks) * SEGMENT_BITS for k in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(own[k] for k in chosen)) for chosen in combinations(range(blocks), blocks - distance)]


def cells(nodes: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``rep, fp, cell``: a cell is the hash of the chosen blocks' counts; a collision of two cells only
    adds candidates."""
    masks = F.array(*[F.lit(m).cast("long") for m in cell_masks(blocks)])
    spread = nodes.select("rep", "fp", embedding(F.col("fp")).alias("e")).select("rep", "fp", "e", F.explode(masks).alias("mask"))
    return spread.select("rep", "fp", F.xxhash64(F.col("e").bitwiseAND(F.col("mask")), "mask").alias("cell"))


def _ball(radius: int = DISTANCE // 2) -> list[int]:
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [_signed(m) for m in masks]


def roots(prints: np.ndarray) -> np.ndarray:
    """For each print the place of the first one that pairs within ``DISTANCE`` bits lead to."""
    n = len(prints)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= DISTANCE
    least = np.arange(n)
    while True:
        new = np.where(near, least[None, :], n).min(axis=1)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _stars(held: DataFrame) -> DataFrame:
    """Links ``a, b`` of cells ``all: array<struct<rep, fp>>``, one row a linked member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            column = batch.column(0)
            ends = column.offsets.to_numpy()
            reps, prints = (column.values.field(k).to_numpy() for k in (0, 1))
            for lo, hi in zip(ends, ends[1:], strict=False):
                order = np.argsort(reps[lo:hi])
                at = roots(prints[lo:hi][order].view("<u8"))
                own = reps[lo:hi][order]
                moved = at != np.arange(len(at))
                found.update(zip(own[at[moved]].tolist(), own[moved].tolist(), strict=True))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return held.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, blocks: int = BLOCKS, spent: list[str] | None = None) -> DataFrame:
    """Edges ``a, b`` between nodes ``(fp, rep)`` that connect exactly what pairs within 4 bits connect.

    ``spent`` receives the paths of tables that the result reads and nothing needs after it.
    """
    spent = [] if spent is None else spent
    nodes = nodes.repartition(max(1, -(-nodes.count() // PER_TASK)), "rep")
    every = cells(nodes, blocks)
    sizes = materialize(every.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-cells")
    # one plan at every size: a merge join, whose hot cells Spark splits
    shared = materialize(every.join(sizes.hint("merge"), "cell"), "simhash-shared")
    spent += [path_of(sizes), path_of(shared)]
    node = F.struct("rep", "fp").alias("node")
    held = shared.where(F.col("n") <= HELD).groupBy("cell").agg(F.collect_list(node).alias("all")).select("all")
    masks = F.array(*[F.lit(m).cast("long") for m in _ball()])
    around = shared.where(F.col("n") > HELD).select("fp", "rep").distinct().select("rep", F.explode(masks).alias("mask"), "fp").select("rep", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    points = around.select(F.min("rep").over(Window.partitionBy("point")).alias("a"), F.col("rep").alias("b")).where("a <> b")
    return _stars(held).unionByName(points).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", spent: list[str] | None = None) -> DataFrame:
    """Per row ``doc_id, fingerprint, component_id``: linked at 4 or fewer differing bits.

    ``component_id`` is the least id reachable over links, itself included. Null text counts as
    empty; all texts without words share fingerprint zero. Rows that repeat an id keep their own
    rows. Null ids link nothing: their component is that of their fingerprint's other rows, or null.
    An empty table gives no rows; other columns are ignored. ``spent`` receives the paths of tables that
    the result reads and nothing needs after it.
    """
    later = [] if spent is None else spent
    prints = materialize(fingerprints(docs, words, id_col, text_col), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "simhash-nodes")
    done: list[str] = []
    found = components(links(nodes, spent=done), spent=later)
    for path in done:
        delete(docs.sparkSession, path)
    later += [path_of(prints), path_of(nodes)]
    of = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is their component's; all columns stay.

    Links are fingerprints within 4 bits or, where ``similarity`` is given, texts whose sets of word
    shingles have that Jaccard similarity or more: of these the grid proposes what its radius reaches, and
    MinHash the rest, most of which lies beyond 4 bits (``similar.py``); the sets decide.
    Null text counts as empty, and texts without words are alike. Rows with a null id stay; of rows
    that repeat an id all stay if any does. An empty table stays empty; columns may have any names. The
    ids that go are written first, so that a short list of them meets the texts without a shuffle of the texts.
    """
    spent: list[str] = []
    if similarity is None:
        of = near_duplicates(docs, words, id_col, text_col, spent)
    else:
        of = similar.classes(docs, words, similarity, id_col, text_col, spent, lambda nodes, used: links(nodes, spent=used))
    gone = of.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone")
    gone = materialize(gone.select(F.col("doc_id").alias(id_col)), "simhash-gone", drop=spent)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
