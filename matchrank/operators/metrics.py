"""Confusion counts, F1 curves over rates and thresholds, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchrank.functions.numeric import budget, macro_f1
from matchrank.operators.decisions import mandatory_rows
from matchrank.operators.lineage import cut, sorted_join
from matchrank.operators.ranking import describe, positions


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``tp, fp, fn, tn, macro_f1`` in one row."""
    count = lambda y, p: F.coalesce(F.sum(F.when((F.col(label) == y) & (F.col(prediction) == p), 1).otherwise(0)), F.lit(0)).cast("long")
    out = df.agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    return out.withColumn("macro_f1", macro_f1(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def rate_curve(df: DataFrame, rates: list[float], base: int = 0, key: str = "term_id", score: str = "score", tie: str = "id", label: str = "label") -> DataFrame:
    """Per feasible rate ``rate, predicted, tp, macro_f1, mandatory_count``.

    One ordering serves all rates: true positives of a rate are the mandatory ones plus the labels
    among the first positions, summed per rate in one aggregation over a short list of budgets.
    """
    spark = df.sparkSession
    marked = cut(mandatory_rows(df, base, key, score, tie))
    totals = marked.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(F.col("mandatory").cast("long")), F.lit(0)).alias("mandatory_count"),
        F.coalesce(F.sum(F.when(F.col("mandatory"), F.col(label)).otherwise(0).cast("long")), F.lit(0)).alias("mandatory_tp"),
    )
    grid = spark.createDataFrame([(float(r),) for r in rates], "rate double")
    asked = grid.crossJoin(F.broadcast(totals)).withColumn("predicted", budget(F.col("n"), F.col("rate"))).where("predicted >= mandatory_count AND predicted <= n")
    ordered = positions(marked.where("NOT mandatory").select(key, F.col(score), F.col(tie), F.col(label)), score, tie, "p").where(F.col(label) == 1)
    # the list of budgets is as long as the list of rates
    hits = ordered.select("p").join(F.broadcast(asked.select("rate", (F.col("predicted") - F.col("mandatory_count")).alias("more"))), F.col("p") <= F.col("more")).groupBy("rate").agg(F.count(F.lit(1)).alias("extra"))
    tp = F.col("mandatory_tp") + F.coalesce("extra", F.lit(0))
    out = asked.join(F.broadcast(hits), "rate", "left").withColumn("tp", tp).withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("positives") - F.col("tp"))
    out = out.withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"))
    return out.select("rate", "predicted", "tp", macro_f1(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("macro_f1"), "mandatory_count")


def best_rate(curve: DataFrame) -> DataFrame:
    """The best macro-F1; the first rate wins ties."""
    return curve.orderBy(F.col("macro_f1").desc(), "rate").limit(1)


def threshold_scan(df: DataFrame, low: float, high: float, step: float, score: str = "score", label: str = "label") -> DataFrame:
    """Macro-F1 at each threshold from one histogram of scores over the thresholds."""
    n = round((high - low) / step) + 1
    points = df.sparkSession.range(n).select(F.col("id").cast("int").alias("k"), F.round(low + F.col("id") * step, 9).alias("threshold"))
    # how many thresholds a score reaches; computed with the rounded thresholds themselves
    reach = F.size(F.filter(F.array(*[F.lit(round(low + k * step, 9)) for k in range(n)]), lambda t: F.col(score) >= t))
    binned = df.groupBy(reach.alias("reach")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("pos"))
    totals = binned.agg(F.sum("rows").alias("n"), F.sum("pos").alias("positives"))
    above = points.join(F.broadcast(binned), F.col("reach") > F.col("k"), "left").groupBy("k", "threshold").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("predicted"), F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"))
    out = above.crossJoin(F.broadcast(totals)).withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("positives") - F.col("tp"))
    out = out.withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"))
    return out.select("threshold", "predicted", "tp", macro_f1(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("macro_f1"))


def recall_at(retrieved: DataFrame, positives: DataFrame, rank: str, ks: list[int]) -> DataFrame:
    """``k, hits, positives, recall`` of (term_id, item_id) pairs."""
    hit = positives.join(sorted_join(retrieved.select("term_id", "item_id", rank)), ["term_id", "item_id"], "left")
    sums = hit.agg(F.count(F.lit(1)).alias("positives"), *[F.coalesce(F.sum((F.col(rank) <= k).cast("long")), F.lit(0)).alias(f"h{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])).alias("x")
    return sums.select(rows, "positives").select("x.k", "x.hits", "positives", (F.col("x.hits") / F.greatest("positives", F.lit(1))).alias("recall"))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def share_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per value and their share of all."""
    counts = group_sizes(df, key)
    return counts.withColumn("ratio", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1)))


def pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    pos, neg = (F.sum((F.col(label) == v).cast("long")) for v in (1, 0))
    return df.agg((neg / F.greatest(pos, F.lit(1))).alias("pos_weight"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per value, the most frequent first, then by value."""
    return group_sizes(df, key).orderBy(F.col("n").desc(), key)


def recall_variants(lexical: DataFrame, embedding: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """``variant, hits, positives, recall`` at rank ``k`` of either retrieval and of their union."""
    first = lambda df: df.where(F.col("rank") <= k).select("term_id", "item_id").distinct()
    pools = {"tfidf": first(lexical), "embedding": first(embedding)}
    marked = positives.select("term_id", "item_id").distinct()
    for name, pool in pools.items():
        marked = marked.join(sorted_join(pool.withColumn(name, F.lit(1))), ["term_id", "item_id"], "left")
    hits = {"tfidf": F.col("tfidf"), "embedding": F.col("embedding"), "hybrid": F.coalesce("tfidf", "embedding")}
    sums = marked.agg(F.count(F.lit(1)).alias("positives"), *[F.count(c).alias(n) for n, c in hits.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("hits")) for n in hits])).alias("x")
    return sums.select(rows, "positives").select("x.variant", "x.hits", "positives", (F.col("x.hits") / F.greatest("positives", F.lit(1))).alias("recall"))


def weighted_mean_loss(batches: DataFrame, loss: str = "loss", rows: str = "rows") -> DataFrame:
    """The mean of batch losses weighted by their rows, in one row; 0 without rows."""
    return batches.agg((F.coalesce(F.sum(F.col(loss) * F.col(rows)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(rows), F.lit(0)), F.lit(1))).alias("mean_loss"))


def score_summary(df: DataFrame, thresholds: list[float], score: str = "score", key: str = "term_id") -> DataFrame:
    """``what, value``: the table's describe, rows at or above each threshold, and the describe of rows per term."""
    facts = lambda d, c, prefix: describe(d, c, (0.25, 0.5, 0.75)).select(*[F.col(n).cast("double").alias(f"{prefix}{n}") for n in ("n", "mean", "std", "lowest", "p25", "p50", "p75", "highest")])
    above = df.agg(*[F.coalesce(F.sum((F.col(score) >= t).cast("double")), F.lit(0.0)).alias(f"at_least_{t:g}") for t in thresholds])
    wide = facts(df, score, "score_").crossJoin(above).crossJoin(facts(group_sizes(df, key), "n", "per_term_"))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(f"`{c}`").alias("value")) for c in wide.columns])).alias("x")).select("x.*")
