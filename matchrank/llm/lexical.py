"""Ranked lexical search through an index in tiers of impact.

Documents are dealt into blocks as they are read, without a shuffle; a block's postings are rows of
(block, term, places, gains), split over tiers: postings of high impact first. A query is answered
from the top tier as far as that proves the answer: the k-th best sum found so far must beat the bound
of every document that isn't a finalist, a bound made of what was found and each term's largest gain
in the tiers below. Finalists then get their exact sums by a join; items without proof fall through to
the next tier, and the last one proves everything. Nothing is cut off: a tier is an order of reading.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from matchrank.llm.arrow import slices
from matchrank.llm.storage import fresh_dir, materialize, small_batches

# fixed values: terms, and the constants of the gain
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAIN, SHARE, LENGTH, BASE = 1_000_000_000, 1_000, 12, 25

#: A block ends with the slice of documents that reaches so many rows or characters.
BLOCK_ROWS, BLOCK_BYTES = 8192, 1 << 24
#: Borders of the tiers as parts of the largest impact that a posting can have.
CUTS = (0.25, 0.0625)
#: (item, term) pairs that a search holds at once, and terms that an index can be restricted to while it
#: reads; more items are searched in turns, more terms are restricted by a join.
PAIRS, ASKED = 1 << 18, 1 << 18
#: Rows (finalist, term) up to which Spark may send them to every task; more are joined by a sort, however small
#: their files are.
SENT = 1 << 17


def terms(text: Column) -> Column:
    """The terms of a text, only A-Z lower-cased; null has none."""
    upper = "".join(map(chr, range(65, 91)))
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()), F.lit(TERM), F.lit(0))


def term_bytes(text: str) -> list[bytes]:
    """``terms`` in UTF-8: lower-casing bytes touches A-Z alone, and all others above 127 are letters of terms."""
    return _find(text.encode().lower())


_find = re.compile(rb"[0-9a-z\x80-\xff]+").findall


@dataclass
class Index:
    """Written tables: ``postings`` (tier, block, term, at, gain), ``blocks`` (block, ids in order of
    ``at``), ``terms`` (term, df, weight, below_0..: the largest gain in the tiers below each)."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    tiers: int


def _postings(docs: DataFrame, id_col: str, text_col: str, asked: list[str] | None) -> DataFrame:
    """``block, term, at, tf, n`` of each block's terms; the row without a term has the block's ids and
    lengths. A block's documents are in order of id, null ids last, so that ``at`` breaks ties."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ints = pa.list_(pa.int32())
    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("at", ints), ("tf", ints), ("n", ints), ("ids", pa.list_(to_arrow_type(kind)))])
    known = None if asked is None else {t.encode(): k for k, t in enumerate(asked)}

    class Block:
        """Postings of the documents read so far, in compact arrays; no text is kept."""

        def __init__(self):
            self.index: dict[bytes, int] = {} if known is None else known
            self.term, self.at, self.tf, self.lengths = array("i"), array("i"), array("i"), array("i")
            self.ids: list[pa.Array] = []
            self.rows = self.size = 0

        def add(self, part: pa.RecordBatch) -> None:
            held = []
            for k, text in enumerate(part.column(1).to_pylist()):
                words = term_bytes(text)
                self.size += len(text)
                if not words:
                    continue
                counts = Counter(words)
                if known is not None:
                    mine = counts.keys() & self.index.keys()
                    self.term.extend(map(self.index.__getitem__, mine))
                else:
                    mine = counts.keys()
                    self.term.extend([self.index.setdefault(w, len(self.index)) for w in mine])
                self.tf.extend(map(counts.__getitem__, mine))
                self.at.extend([len(self.lengths)] * len(mine))
                self.lengths.append(len(words))
                held.append(k)
            self.ids.append(part.column(0).take(pa.array(held, pa.int32())))
            self.rows += part.num_rows

        def batch(self, number: int) -> pa.RecordBatch:
            ids = pa.concat_arrays(self.ids)
            order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            term, at, tf, lengths = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (self.term, self.at, self.tf, self.lengths))
            n, at = lengths[at], place[at]
            by_term = np.lexsort((at, term))
            present, starts = np.unique(term[by_term], return_index=True)
            offsets = pa.array(np.append(np.append(starts, len(term)), len(term) + len(lengths)), pa.int32())
            over = lambda values, last: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([values[by_term], last])))
            lists = pa.ListArray.from_arrays(pa.array([0] * (len(present) + 1) + [len(ids)], pa.int32()), ids.take(pa.array(order)))
            words = list(self.index)
            names = pa.array([words[k].decode() for k in present] + [None], pa.string())
            lengths = lengths[order]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(present) + 1, number)), names, over(at, np.arange(len(order), dtype=np.int32)), over(tf, lengths), over(n, lengths), lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for part in slices(batch):
                block.add(part)
                if block.rows >= BLOCK_ROWS or block.size >= BLOCK_BYTES:
                    if block.lengths:
                        yield block.batch(number)
                    number, block = number + 1, Block()
        if block.lengths:
            yield block.batch(number)

    return rows.mapInArrow(run, f"block long, term string, at array<int>, tf array<int>, n array<int>, ids array<{kind.simpleString()}>")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asked: DataFrame | None = None, cuts: tuple[float, ...] = CUTS) -> Index:
    """The index of all rows of ``docs``, of all terms or of those of ``asked`` (``term``).

    A posting's impact is ``weight * gain``; tier k holds impacts of at least ``cuts[k]`` of the largest one
    that can be, the last tier the rest. N and L, the counts and lengths are over all rows and terms.
    Rows without terms (null and empty texts) are in no block. Rows are documents each: repeated ids are
    indexed each, null ids too. An empty table makes an empty index; other columns are ignored.
    """
    spark = docs.sparkSession
    wanted = None
    if asked is not None:
        asked = materialize(asked.select("term").distinct(), "lexical-asked")
        wanted = [r.term for r in asked.collect()] if asked.count() <= ASKED else None
    raw = _postings(docs, id_col, text_col, wanted)
    with small_batches(spark):
        raw = materialize(raw, "lexical-raw")
    facts = raw.where("term IS NULL").agg(F.sum(F.size("at")).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("terms")).first()
    n_docs, n_terms = facts["docs"] or 0, max(facts["terms"] or 0, 1)
    weight = lambda df: F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2) / (2.0 * df + 1)))
    named = raw.where("term IS NOT NULL")
    if asked is not None and wanted is None:
        named = named.join(asked, "term", "left_semi")
    counted = materialize(named.groupBy("term").agg(F.sum(F.size("at")).cast("long").alias("df")).withColumn("weight", weight(F.col("df"))), "lexical-counts")
    largest = float(np.floor(1000 * np.log((2.0 * n_docs + 2) / 3.0))) * (GAIN / SHARE) if n_docs else 0.0
    borders = [c * largest for c in cuts]
    ints = pa.list_(pa.int32())
    schema = pa.schema([("tier", pa.int32()), ("block", pa.int64()), ("term", pa.string()), ("at", ints), ("gain", ints)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [b.column(name).flatten().to_numpy() for name in ("at", "tf", "n")]
            at, tf, n = (x.astype(np.int64) for x in flat)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("at")).to_numpy())
            gain = (GAIN * tf) // (SHARE * tf + LENGTH * (100 - BASE + (BASE * n * n_docs) // n_terms))
            impact = b.column("weight").to_numpy()[row] * gain
            tier = np.sum([impact < c for c in borders], axis=0) if borders else np.zeros(len(impact), np.int64)
            for k in range(len(borders) + 1):
                mine = tier == k
                sizes = np.bincount(row[mine], minlength=b.num_rows)
                held = np.flatnonzero(sizes)
                if len(held):
                    offsets = pa.array(np.append(0, np.cumsum(sizes[held])), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[mine], pa.int32())) for x in (at, gain)]
                    take = pa.array(held)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), k, np.int32)), b.column("block").take(take), b.column("term").take(take), *lists], schema=schema)

    # an index of few terms joins a small table; else the join shuffles postings by term, and AQE splits hot terms
    tiered = named.join(counted.select("term", "weight"), "term").select("block", "term", "at", "tf", "n", "weight").mapInArrow(split, "tier int, block long, term string, at array<int>, gain array<int>")
    path = fresh_dir(spark, "lexical-postings")
    # files in order of term let a search skip most row groups
    with small_batches(spark):
        tiered.sortWithinPartitions("tier", "term").write.partitionBy("tier").parquet(path)
    postings = spark.read.schema("block long, term string, at array<int>, gain array<int>, tier int").parquet(path)
    below = [F.coalesce(F.max(F.when(F.col("tier") > k, F.array_max("gain"))), F.lit(0)).alias(f"below_{k}") for k in range(len(cuts) + 1)]
    bounds = postings.groupBy("term").agg(*below)
    return Index(postings, raw.where("term IS NULL").select("block", "ids"), materialize(counted.join(bounds, "term"), "lexical-terms"), len(cuts) + 1)


def _small(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table held by the plan, whose size Spark knows when it chooses a join; at most ``PAIRS`` rows."""
    return spark.createDataFrame(pa.table(columns))


def _pass(index: Index, tier: int, queries: dict[int, list[tuple[str, int, int]]], k: int, id_type: str) -> DataFrame:
    """``item, block, at, doc_id, low, high``: of each block and item the ``k`` best sums over the tiers
    up to ``tier`` with their bounds, and one row (``at`` = -1) with the largest bound of the others."""
    last = tier == index.tiers - 1
    spark = index.postings.sparkSession
    names = sorted({t for q in queries.values() for t, _, _ in q})
    number = {t: i for i, t in enumerate(names)}
    asked = [(item, [(number[t], w, below) for t, w, below in q], sum(w * below for _, w, below in q)) for item, q in queries.items()]
    ids_type = to_arrow_type(index.blocks.schema["ids"].dataType.elementType)
    schema = pa.schema([("item", pa.int32()), ("block", pa.int64()), ("at", pa.int32()), ("doc_id", ids_type), ("low", pa.int64()), ("high", pa.int64())])

    def score(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, found = None, {}
        for name, ids_, at, gain in zip(t.column("term").to_pylist(), t.column("ids").chunk(0), t.column("at").chunk(0), t.column("gain").chunk(0), strict=True):
            if name is None:
                ids = ids_.values
            else:
                found.setdefault(number[name], []).append((at.values.to_numpy(), gain.values.to_numpy().astype(np.int64)))
        size, block = len(ids), t.column("block")[0].as_py()
        out: list[list[np.ndarray]] = [[], [], [], []]
        for item, query, most in asked:
            low = np.zeros(size, np.int64)
            high = low if last else np.full(size, most)
            for term, weight, below in query:
                for at, gain in found.get(term, ()):
                    low[at] += weight * gain
                    if not last:
                        high[at] += weight * (gain - below)
            hit = np.flatnonzero(low)
            # by sum, then by place, which is the order of ids
            best = hit[np.argsort(-low[hit], kind="stable")[:k]]
            lows, highs = low[best], high[best]
            if not last and len(best) < size:
                rest = np.ones(size, bool)
                rest[best] = False
                best, lows, highs = np.append(best, -1), np.append(lows, 0), np.append(highs, high[rest].max())
            for column, values in zip(out, (np.full(len(best), item), best, lows, highs), strict=True):
                column.append(values)
        item, at, low, high = (np.concatenate(x) for x in out)
        docs = ids.take(pa.array(at, mask=at < 0))
        return pa.table([pa.array(item, pa.int32()), pa.array(np.full(len(at), block)), pa.array(at, pa.int32()), docs, pa.array(low), pa.array(high)], schema=schema)

    wanted = _small(spark, term=pa.array(names, pa.string()))
    rows = index.postings.where(F.col("tier") <= tier).join(wanted, "term", "left_semi")
    empty = F.lit(None)
    both = rows.select("block", "term", "at", "gain", empty.cast(f"array<{id_type}>").alias("ids")).unionByName(index.blocks.select("block", empty.cast("string").alias("term"), empty.cast("array<int>").alias("at"), empty.cast("array<int>").alias("gain"), "ids"))
    return both.groupBy("block").applyInArrow(score, f"item int, block long, at int, doc_id {id_type}, low long, high long")


def _first(df: DataFrame, score: str, k: int) -> DataFrame:
    """The ``k`` best rows per item with their ``rank``; ties by id, null ids last, then by place."""
    w = Window.partitionBy("item").orderBy(F.col(score).desc(), F.col("doc_id").asc_nulls_last(), "block", "at")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", report: list | None = None) -> DataFrame:
    """``<item_col>, rank, doc_id, score``: each item's ``k`` best documents with a sum above 0, ties by id.

    Items are read whole; rows that repeat an item's id are one item with the terms of all of them, and
    a null id is an item too. Items without terms, or whose terms no document has, have no rows.
    Rows of the index that repeat a document's id rank each. ``report`` collects (tier, items asked,
    items proven) of each pass.
    """
    spark = items.sparkSession
    kind, id_type = items.schema[item_col].dataType.simpleString(), index.blocks.schema["ids"].dataType.elementType.simpleString()
    below = [f"below_{j}" for j in range(index.tiers)]
    pairs = items.select(F.col(item_col).alias("item_id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    pairs = materialize(pairs.join(index.terms, "term").where("weight > 0").select("item_id", "term", (F.col("times") * F.col("weight")).alias("weight"), *below), "lexical-pairs")
    turns = max(1, -(-pairs.count() // PAIRS))
    parts = []
    for turn in range(turns):
        held = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).collect()
        names = {i: n for n, i in enumerate(dict.fromkeys(r.item_id for r in held))}
        asked: dict[int, list] = {n: [] for n in names.values()}
        for r in held:
            asked[names[r.item_id]].append(r)
        done = [_exact(index, asked, tier, k, id_type, report) for tier in range(index.tiers) if asked]
        labels = _small(spark, item=pa.array(names.values(), pa.int32()), item_id=pa.array(names, to_arrow_type(items.schema[item_col].dataType)))
        parts += [_first(d, "score", k).join(labels, "item") for d in done if d is not None]
    if not parts:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, doc_id {id_type}, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("item_id").alias(item_col), "rank", "doc_id", "score")


def _exact(index: Index, asked: dict[int, list], tier: int, k: int, id_type: str, report: list | None) -> DataFrame | None:
    """Finalists with exact ``score`` of the items that ``tier`` proves; these leave ``asked``."""
    if not asked:
        return None
    last = tier == index.tiers - 1
    found = materialize(_pass(index, tier, {n: [(r.term, r.weight, r[f"below_{tier}"]) for r in q] for n, q in asked.items()}, k, id_type), f"lexical-tier-{tier}")
    sums = found.where("at >= 0")
    if last:
        proven = dict.fromkeys(asked, 0)
    else:
        edge = _first(sums, "low", k).where(F.col("rank") == k).select("item", F.col("low").alias("edge"))
        rest = found.where("at < 0").groupBy("item").agg(F.max("high").alias("rest"))
        proven = {r.item: r.edge for r in edge.join(rest, "item", "left").where("coalesce(rest, 0) < edge").collect()}
    if report is not None:
        report.append((tier, len(asked), len(proven)))
    if last:
        asked.clear()
        return sums.select("item", "block", "at", "doc_id", F.col("low").alias("score"))
    if not proven:
        return None
    spark = found.sparkSession
    edges = _small(spark, item=pa.array(proven, pa.int32()), edge=pa.array(proven.values(), pa.int64()))
    rows = [(n, r) for n in proven for r in asked.pop(n)]
    query = _small(spark, item=pa.array([n for n, _ in rows], pa.int32()), term=pa.array([r.term for _, r in rows], pa.string()), weight=pa.array([r.weight for _, r in rows], pa.int64()))
    final = sums.join(edges, "item").where("high >= edge").select("item", "block", "at", "doc_id")
    wanted = materialize(final.join(query, "item"), "lexical-finalists")
    if wanted.count() > SENT:
        wanted = wanted.hint("merge")
    hit = index.postings.select("block", "term", F.col("at").alias("places"), "gain").join(wanted, ["block", "term"]).withColumn("p", F.array_position("places", F.col("at"))).where("p > 0")
    exact = hit.groupBy("item", "block", "at", "doc_id").agg(F.sum(F.col("weight") * F.element_at("gain", F.col("p").cast("int"))).alias("score"))
    return materialize(exact, f"lexical-exact-{tier}")
