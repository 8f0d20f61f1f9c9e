"""Categories of any number as numbers: ordered target statistics.

A training row's category becomes the mean label of the rows of that category that come before it in a
random order (a hash of the row's key), mixed with a prior; so no row sees its own label, nor any row
that shares its key. Other rows take the statistics of all training rows. Prefix sums never gather a
category in one task: rows are range-partitioned by (category, hash), a category that fills several
partitions adds up the totals of the earlier ones, and the rest is a window inside a partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchrank.functions.numeric import stable_hash
from matchrank.operators.lineage import cut


def row_order(key: str, seed: str) -> Column:
    """60 bits of the key's hash, as a long."""
    return F.conv(F.substring(stable_hash(seed, F.col(key).cast("string")), 1, 15), 16, 10).cast("long")


def _category(name: str) -> Column:
    """Null is a category of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def _mean(total: Column, n: Column, prior: float, strength: float) -> Column:
    zero = F.lit(0)
    return (F.coalesce(total, zero) + prior * strength) / (F.coalesce(n, zero) + strength)


def earlier_sums(rows: DataFrame, category: str, order: str, label: str) -> DataFrame:
    """``rows`` with ``_sum`` and ``_n`` of the labels of the same category at strictly smaller ``order``."""
    ordered = cut(cut(rows).repartitionByRange(category, order).withColumn("_b", F.spark_partition_id()))
    value = F.col(label).cast("double")
    # a row per category and range partition: a category spans several only where it is large
    parts = ordered.groupBy(category, "_b").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(category).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = parts.select(category, "_b", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_c0"))
    inside = Window.partitionBy("_b", category).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    own = ordered.withColumns({"_sum": F.coalesce(F.sum(value).over(inside), F.lit(0.0)), "_n": F.count(F.lit(1)).over(inside)})
    out = own.join(earlier, ["_b", category])
    return out.withColumns({"_sum": F.col("_sum") + F.col("_s0"), "_n": F.col("_n") + F.col("_c0")}).drop("_b", "_s0", "_c0")


@dataclass
class TargetStatistics:
    """Fitted statistics: per categorical column a table ``category, total, n`` over the training rows."""

    prior: float
    strength: float
    tables: dict[str, DataFrame]

    def encode(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``<name>_ts`` per column, from all training rows; an unseen category has the prior."""
        for name, table in self.tables.items():
            known = table.select(F.col("category").alias("_category"), F.col("total").alias("_total"), F.col("n").alias("_n"))
            rows = rows.withColumn("_category", _category(name)).join(known, "_category", "left")
            rows = rows.withColumn(f"{name}_ts", _mean(F.col("_total"), F.col("_n"), self.prior, self.strength)).drop("_category", "_total", "_n")
        return rows


def fit_statistics(rows: DataFrame, categorical: list[str], label: str = "label", strength: float = 1.0) -> TargetStatistics:
    """Statistics of all ``rows``; the prior is their mean label. Tables are written, as any number of encodings use them."""
    prior = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    table = lambda name: cut(rows.groupBy(_category(name).alias("category")).agg(F.sum(F.col(label).cast("double")).alias("total"), F.count(F.lit(1)).alias("n")))
    return TargetStatistics(prior, strength, {name: table(name) for name in categorical})


def encode_training(rows: DataFrame, statistics: TargetStatistics, key: str, label: str = "label", seed: str = "ordered") -> DataFrame:
    """The training rows themselves with ``<name>_ts``, each from the rows before it in the order of ``key``'s hash.

    Rows that share a key don't see each other's labels. A category's first row has the prior.
    """
    if not statistics.tables:
        return rows
    out = rows.withColumn("_order", row_order(key, seed))
    for name in statistics.tables:
        out = earlier_sums(out.withColumn("_category", _category(name)), "_category", "_order", label)
        out = out.withColumn(f"{name}_ts", _mean(F.col("_sum"), F.col("_n"), statistics.prior, statistics.strength)).drop("_category", "_sum", "_n")
    return out.drop("_order")
