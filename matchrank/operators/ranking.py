"""Ranks, quantile bins and positions that hold in a total order over the whole table.

A window without a key would sort the table in one task. ``place`` instead range-partitions the rows
by the whole order, ties included, so a value that many rows share is cut by its ties; each row's
place in its partition plus the sizes of earlier partitions is its position. ``value_counts`` does the same
for distinct values with their counts, of which percentile ranks and exact quantiles are read.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchrank.operators.lineage import cut


def place(df: DataFrame, *order: Column, out: str = "position") -> DataFrame:
    """``df`` with 1-based positions in ``order``, which must be total for the result to be unique.

    The input is evaluated once, as range partitioning samples it before it moves it. Keys may be of
    any type that sorts.
    """
    ordered = cut(cut(df).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition
    sizes = ordered.groupBy(part.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_b", "_off")
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("_b", part).join(F.broadcast(sizes), "_b").withColumn(out, F.col("_off") + inside + 1).drop("_b", "_m", "_off")


def positions(df: DataFrame, score: str, tie: str, out: str = "position") -> DataFrame:
    """``df`` with 1-based positions by score descending, then ``tie`` (unique, of any type) ascending."""
    return place(df, F.col(score).desc(), F.col(tie).asc(), out=out)


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """``value, _c, _before, _all``: rows of each distinct value, of smaller ones, and of all; no nulls."""
    values = cut(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c")))
    ordered = cut(values.repartitionByRange(value).withColumn("_b", F.spark_partition_id()))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition
    sizes = ordered.groupBy("_b").agg(F.sum("_c").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy())).drop("_n")
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counted = ordered.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    return counted.join(F.broadcast(sizes), "_b").select(value, "_c", (F.col("_off") + F.col("_in")).alias("_before"), "_all")


def quantiles(df: DataFrame, value: str, named: dict[str, float]) -> DataFrame:
    """Exact linear quantiles in one row, a column per name; nulls without values."""
    n = df.select(F.count(value)).first()[0]
    counts = value_counts(df, value)
    at = lambda k: F.min(F.when(F.col("_before") + F.col("_c") > k, F.col(value))).cast("double")

    def one(p: float) -> Column:
        x = (n - 1) * p
        low = at(floor(x))
        return low + (at(ceil(x)) - low) * (x - floor(x))

    return counts.agg(*[(one(p) if n else F.lit(None).cast("double")).alias(name) for name, p in named.items()])


def rank_pct(df: DataFrame, score: str, out: str, *keys: str) -> DataFrame:
    """Average-tie percentile rank, ascending, over the table or per key; a null score has a null rank.

    Over the table, rows are counted per distinct value first, so ties never meet in one task.
    """
    if keys:
        peers, group = Window.partitionBy(*keys, score), Window.partitionBy(*keys)
        rank = (F.rank().over(group.orderBy(F.col(score).asc_nulls_last())) + (F.count(F.lit(1)).over(peers) - 1) / 2) / F.count(score).over(group)
        return df.withColumn(out, F.when(F.col(score).isNotNull(), rank))
    ranked = value_counts(df, score).select(score, ((F.col("_before") + (F.col("_c") + 1) / 2) / F.col("_all")).alias(out))
    return df.join(ranked, score, "left").select(*df.columns, out)


def first_rank(df: DataFrame, key: str, score: str, tie: str, out: str = "rank_in_term") -> DataFrame:
    """Descending rank within a key, ties to the smaller id, and the group's size."""
    w = Window.partitionBy(key)
    return df.withColumn(out, F.row_number().over(w.orderBy(F.col(score).desc(), F.col(tie)))).withColumn("term_size", F.count(F.lit(1)).over(w))


def quantile_bins(df: DataFrame, value: str, tie: str, bins: int, out: str = "bin", *keys: str) -> DataFrame:
    """Equal-width bins of the first-tie ascending rank: ``ceil((r-1)q/(n-1)) - 1``, 0 at least."""
    if keys:
        w = Window.partitionBy(*keys)
        df = df.withColumn("_r", F.row_number().over(w.orderBy(value, tie))).withColumn("_n", F.count(F.lit(1)).over(w))
    else:
        placed = place(df, F.col(value).asc(), F.col(tie).asc(), out="_r")
        df = placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("_n"))))
    bin_ = F.ceil((F.col("_r") - 1) * bins / F.greatest(F.col("_n") - 1, F.lit(1))) - 1
    return df.withColumn(out, F.greatest(bin_, F.lit(0)).cast("int")).drop("_r", "_n")


def top_k(df: DataFrame, key: str, score: str, tie: str, k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows per key by score descending, then id; Spark prunes before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def top_n(df: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(tie)).limit(n)


def describe(df: DataFrame, value: str, percentiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact linear percentiles in one row."""
    facts = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    cuts = quantiles(df, value, {f"p{round(p * 100):02d}": p for p in percentiles})
    return facts.crossJoin(F.broadcast(cuts)).select("n", "mean", "std", "lowest", *cuts.columns, "highest")


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, one row each, in one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sums = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left_name"), F.lit(b).alias("right_name"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
