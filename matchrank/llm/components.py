"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchrank.llm.storage import delete, materialize, path_of


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: every node hands its least neighbour to the larger ones; small: to the rest."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u")
        out = linked.select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60, spent: list[str] | None = None) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)`` (longs): the least node it reaches.

    Each round is written to the shared folder, so lineage stays one round long; rounds end when the
    edge table no longer changes, usually after the logarithm of a component's diameter. Loops and
    repeated edges are harmless; no edges give no rows. ``most_rounds`` only guards against a defect:
    reaching it raises an error. ``spent`` receives the path of the table that the result reads.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        half = materialize(_star(now, large=True), "edges", [])
        after = materialize(_star(half, large=False), "edges")
        for old in (path_of(half), path_of(now)):
            delete(edges.sparkSession, old)
        now = after
    else:
        raise RuntimeError("components did not settle")
    if spent is not None:
        spent.append(path_of(now))
    roots = now.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
