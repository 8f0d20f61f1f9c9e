"""Rate curves of many blends of the same rows, without a copy of the rows per blend.

A blend orders rows by score, then id; with a base, a term's best rows beyond its ``base`` worst ones come
first. A budget's true positives are the labels before its end in that order, so for each (weighting,
base, rate) one place has to be found. Tasks score all weightings in memory and ship histograms: counts
and labels per bin of the order. The bin that holds the end of a budget is cut into finer bins in the
next round, first by score and then by the id's position, until what is left inside can't change
the count. What is shuffled is the rows once, by term, and histograms, however many weightings there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchrank.functions.numeric import macro_f1
from matchrank.operators.lineage import cut
from matchrank.operators.ranking import place

#: Scores are told apart to 12 digits; a bin is a digit of 14 bits of the order, three of which hold a score between 0 and 1.
SCALE, BITS = 10**12, 14
#: Rows of a term that are ordered at once; a larger term is worked off in chunks and their survivors.
CHUNK = 1 << 16


def _scores(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    """Rows x weightings: blends in units of the last digit."""
    columns = [batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(weights.shape[1])]
    total = columns[0][:, None] * weights[None, :, 0]
    for i in range(1, len(columns)):
        total = total + columns[i][:, None] * weights[None, :, i]
    return np.rint(total * SCALE).astype(np.int64)


def _packed(bits: np.ndarray) -> pa.Array:
    packed = np.packbits(bits, axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(bits), [None, pa.py_buffer(np.ascontiguousarray(packed).tobytes())]).cast(pa.binary())


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    n = -(-width // 8)
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), n)
    return np.unpackbits(raw, axis=1, count=width).astype(bool)


def _slots(df: DataFrame) -> int:
    """Partitions for work that costs more than its bytes tell, which would be merged for being small."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _worst_rows(rows: DataFrame, weights: np.ndarray, bases: list[int]) -> DataFrame:
    """``rows`` with ``free``: a bit per base and weighting that is set for the term's ``base`` worst rows.

    Terms of up to ``CHUNK`` rows are ordered at once. A larger one is dealt into chunks by a hash; a row that
    isn't among the worst of its chunk isn't among the worst of the term, and the others go on to
    the next, smaller round. A chunk is at least four times as large as what can go on from it.
    """
    names = [c for c in rows.columns if c != "free"]
    width = len(weights) * len(bases)
    chunk = max(CHUNK, 4 * len(weights) * sum(bases))
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            b = t.combine_chunks().to_batches()[0]
            key = b.column("_g").to_numpy()
            group = np.cumsum(np.append(0, key[1:] != key[:-1]))
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            score, pos = _scores(b, weights), b.column("pos").to_numpy()
            may = _unpacked(b.column("free"), width)
            free = np.zeros((b.num_rows, width), bool)
            for w in range(len(weights)):
                for j, base in enumerate(bases):
                    column = j * len(weights) + w
                    # from the worst on; rows that an earlier round ruled out come last
                    order = np.lexsort((-pos, score[:, w], ~may[:, column], group))
                    rank = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.append(starts, b.num_rows)))
                    free[order, column] = rank < base
            free &= may
            return pa.RecordBatch.from_arrays([*[b.column(c) for c in names], b.column("chunks"), _packed(free)], [*names, "chunks", "free"])

        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = held.column("_g").to_numpy()
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if last:  # all but the last group are whole
                yield done(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield done(held)

    every = _packed(np.ones((1, width), bool))[0].as_py()
    open_rows, parts = rows.withColumn("free", F.lit(bytearray(every))), []
    while True:
        sizes = open_rows.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("chunks"))
        dealt = open_rows.join(sizes, "term").withColumn("_g", F.xxhash64("term", F.pmod(F.xxhash64("pos"), F.col("chunks"))))
        # a group is a run of one key of a partition; terms whose hashes collide would only share a sort if they had one key
        sorted_rows = dealt.withColumn("_t", F.xxhash64("term")).repartition(_slots(rows), "_t", "_g").sortWithinPartitions("_t", "_g").select(*names, "free", "chunks", "_g")
        marked = cut(sorted_rows.mapInArrow(mark, f"{kind}, chunks long, free binary"))
        none = F.lit(bytearray(len(every)))
        parts.append(marked.where((F.col("chunks") == 1) | (F.col("free") == none)).drop("chunks"))
        open_rows = cut(marked.where((F.col("chunks") > 1) & (F.col("free") != none)).drop("chunks"))
        if not open_rows.limit(1).count():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class _Target:
    """The end of one budget: how many rows of bin ``prefix`` at ``level`` are inside it, and labels before."""

    weighting: int
    base: int
    rate: float
    need: int
    tp: int
    prefix: tuple[int, ...] = field(default=())
    done: bool = False


def grid_curve(aligned: DataFrame, weights: list[dict[str, float]], rates: list[float], bases: list[int], tie: str = "id", label: str = "label", term: str = "term_id") -> DataFrame:
    """Per weighting, base and rate: ``weight_id, base, rate, macro_f1, mandatory_count``; feasible points only.

    ``aligned`` has a column per weighted name; weights are not negative. Driver and plan hold one record per
    point of the grid, tasks one histogram per weighting, base and round.
    """
    spark = aligned.sparkSession
    names = list(weights[0])
    matrix = np.array([[w[n] for n in names] for w in weights], float)
    placed = place(aligned.select(F.col(term).alias("term"), F.col(tie).alias("_tie"), F.col(label).cast("int").alias("label"), *[F.col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)]), F.col("_tie").asc(), out="pos").drop("_tie")
    rows = cut(placed)
    n, positives, *limits = rows.agg(F.count(F.lit(1)), F.sum("label"), *[f(f"c{i}") for i in range(len(names)) for f in (F.min, F.max)]).first()
    if not n:
        return spark.createDataFrame([], "weight_id int, base int, rate double, macro_f1 double, mandatory_count long")
    held = [b for b in bases if b > 0]
    marked = cut(_worst_rows(rows, matrix, held)) if held else cut(rows.repartition(_slots(rows), "pos").withColumn("free", F.lit(bytearray(b""))))
    marked = marked.select("label", "pos", "free", *[f"c{i}" for i in range(len(names))])
    low = int(np.floor(min(float(x) * s for x in limits[0::2] for s in (matrix.sum(1).min(), matrix.sum(1).max())) * SCALE)) - 1
    high = int(np.ceil(max(float(x) * s for x in limits[1::2] for s in (matrix.sum(1).min(), matrix.sum(1).max())) * SCALE)) + 1
    score_digits, pos_digits = (max(1, -(-int(x).bit_length() // BITS)) for x in (high - low, n))

    def free_columns(b: pa.RecordBatch) -> dict[int, np.ndarray]:
        bits = _unpacked(b.column("free"), len(held) * len(weights)) if held else None
        return {base: bits[:, held.index(base) * len(weights) : (held.index(base) + 1) * len(weights)] if base > 0 else np.ones((b.num_rows, len(weights)), bool) for base in bases}

    def histogram(groups: dict[tuple[int, int], dict[tuple[int, ...], int]], level: int):
        """Counts and labels per bin of digit ``level`` of the rows whose digits before it are a group's.

        Digits are in decision order: better scores, then earlier positions, come first.
        """
        in_score, in_pos = min(level, score_digits), max(level - score_digits, 0)
        cut_score, cut_pos = BITS * (score_digits - in_score), BITS * (pos_digits - in_pos)
        number = lambda digits: sum(d << (BITS * k) for k, d in enumerate(reversed(digits)))
        tables = {}
        for key, prefixes in groups.items():
            heads = np.unique([number(p[:score_digits]) for p in prefixes])
            codes = np.array([(int(np.searchsorted(heads, number(p[:score_digits]))) << 40) + number(p[score_digits:]) for p in prefixes])
            order = np.argsort(codes)
            tables[key] = heads, codes[order], np.array(list(prefixes.values()))[order]

        def merged(codes: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            distinct, at = np.unique(codes, return_inverse=True)
            return distinct, np.bincount(at, counts, len(distinct)), np.bincount(at, labels, len(distinct))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            so_far = tuple(np.zeros(0, t) for t in (np.int64, float, float))
            for b in batches:
                scores, pos, y, free = high - _scores(b, matrix), b.column("pos").to_numpy(), b.column("label").to_numpy(), free_columns(b)
                found = [so_far]
                for (w, base), (heads, codes, numbers) in tables.items():
                    mine = np.flatnonzero(free[base][:, w])
                    head = scores[mine, w] >> cut_score
                    i = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
                    code = (i << 40) + (pos[mine] >> cut_pos)
                    j = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    inside = (heads[i] == head) & (codes[j] == code)
                    mine, j = mine[inside], j[inside]
                    digit = (scores[mine, w] >> (cut_score - BITS)) if level < score_digits else (pos[mine] >> (cut_pos - BITS))
                    found.append(merged((numbers[j].astype(np.int64) << BITS) + (digit & ((1 << BITS) - 1)), np.ones(len(mine)), y[mine]))
                so_far = merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
            codes, c, p = so_far
            yield pa.RecordBatch.from_arrays([pa.array((codes >> BITS).astype(np.int32)), pa.array((codes & ((1 << BITS) - 1)).astype(np.int32)), pa.array(c.astype(np.int64)), pa.array(p.astype(np.int64))], ["g", "bin", "c", "p"])

        return run

    # what is free per weighting and base; the rest is mandatory
    whole = {(w, b): {(): w * len(bases) + j} for w in range(len(weights)) for j, b in enumerate(bases)}
    first = cut(marked.mapInArrow(histogram(whole, 0), "g int, bin int, c long, p long").groupBy("g", "bin").agg(F.sum("c").alias("c"), F.sum("p").alias("p")))
    sums = {r.g: (r.c, r.p) for r in first.groupBy("g").agg(F.sum("c").alias("c"), F.sum("p").alias("p")).collect()}
    targets = []
    for (w, b), groups in whole.items():
        c, p = sums.get(groups[()], (0, 0))
        for rate in rates:
            predicted = round(n * rate)
            if n - c <= predicted <= n:
                targets.append(_Target(w, b, rate, predicted - (n - c), positives - p, (), predicted == n - c))
    facts = [(t, n - sums.get(whole[t.weighting, t.base][()], (0, 0))[0]) for t in targets]
    level, hist, number = 0, first, whole
    while waiting := [t for t in targets if not t.done]:
        if level:
            number = {}
            for t in waiting:
                number.setdefault((t.weighting, t.base), {}).setdefault(t.prefix, 0)
            for g, (key, prefix) in enumerate((k, p) for k, ps in number.items() for p in ps):
                number[key][prefix] = g
            hist = marked.mapInArrow(histogram(number, level), "g int, bin int, c long, p long").groupBy("g", "bin").agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
        # a row per bin of a histogram
        before = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        summed = hist.withColumns({"c0": F.coalesce(F.sum("c").over(before), F.lit(0)), "p0": F.coalesce(F.sum("p").over(before), F.lit(0))})
        asked = spark.createDataFrame(pa.table({"k": pa.array(range(len(waiting)), pa.int32()), "g": pa.array([number[t.weighting, t.base][t.prefix] for t in waiting], pa.int32()), "need": pa.array([t.need for t in waiting], pa.int64())}))
        for r in summed.join(F.broadcast(asked), "g").where("c0 < need AND need <= c0 + c").collect():
            t = waiting[r.k]
            t.need, t.tp, t.prefix = t.need - r.c0, t.tp + r.p0, (*t.prefix, r.bin)
            if t.need == r.c or r.p in (0, r.c):  # the rest of the bin can't change the count
                t.tp, t.done = t.tp + (r.p if t.need == r.c else 0 if r.p == 0 else t.need), True
        level += 1
    table = pa.table(
        {
            "weight_id": pa.array([t.weighting for t, _ in facts], pa.int32()), "base": pa.array([t.base for t, _ in facts], pa.int32()), "rate": pa.array([float(t.rate) for t, _ in facts]),
            "tp": pa.array([t.tp for t, _ in facts], pa.int64()), "predicted": pa.array([round(n * t.rate) for t, _ in facts], pa.int64()), "mandatory_count": pa.array([m for _, m in facts], pa.int64()),
        }
    )
    out = spark.createDataFrame(table).withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.lit(positives) - F.col("tp")).withColumn("tn", F.lit(n - positives) - F.col("fp"))
    return out.select("weight_id", "base", "rate", macro_f1(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("macro_f1"), "mandatory_count")
