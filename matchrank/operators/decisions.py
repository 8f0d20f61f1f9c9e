"""From scores to binary decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchrank.functions.numeric import budget
from matchrank.functions.text import rate_suffix
from matchrank.operators.lineage import cut
from matchrank.operators.ranking import first_rank, positions, quantiles
from matchrank.sources.contracts import ContractError


def threshold(df: DataFrame, at: float, score: str = "score") -> DataFrame:
    return df.withColumn("prediction", (F.col(score) >= at).cast("int"))


def threshold_per_term(df: DataFrame, at: float, min_per_term: int = 0, max_per_term: int = 0, min_score: float = 0.0, key: str = "term_id", score: str = "score", tie: str = "id") -> DataFrame:
    """Threshold, then per term: its first rows become positive if the best reaches ``min_score``,
    and of its positives only the best ``max_per_term`` stay. 0 turns either off."""
    w = Window.partitionBy(key)
    order = w.orderBy(F.col(score).desc(), F.col(tie))
    out = threshold(df, at, score)
    if min_per_term > 0:
        lift = (F.row_number().over(order) <= min_per_term) & (F.max(score).over(w) >= min_score)
        out = out.withColumn("prediction", F.when(lift, 1).otherwise(F.col("prediction")))
    if max_per_term > 0:
        # a running count of positives in score order: their rank among the term's positives
        nth = F.sum("prediction").over(order.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("prediction", F.when((F.col("prediction") == 1) & (nth <= max_per_term), 1).otherwise(0))
    return out


def _rate(rate: float) -> None:
    if not 0 < rate < 1:
        raise ContractError(f"rate must lie between 0 and 1: {rate}")


def rate(df: DataFrame, share: float, score: str = "score", tie: str = "id") -> DataFrame:
    """Exactly round(rows * share) positives: the best by score, then id."""
    _rate(share)
    placed = positions(df, score, tie, "_p")
    n = F.broadcast(placed.agg(budget(F.count(F.lit(1)), F.lit(share)).alias("_budget")))
    return placed.crossJoin(n).withColumn("prediction", (F.col("_p") <= F.col("_budget")).cast("int")).drop("_p", "_budget")


def rate_quantile(df: DataFrame, share: float, score: str = "score") -> DataFrame:
    """Positive from the exact (1 - share) quantile up; ties there can exceed the share."""
    _rate(share)
    at = F.broadcast(quantiles(df, score, {"_cut": 1 - share}))
    return df.crossJoin(at).withColumn("prediction", (F.col(score) >= F.col("_cut")).cast("int")).drop("_cut")


def mandatory_rows(df: DataFrame, base: int, key: str = "term_id", score: str = "score", tie: str = "id") -> DataFrame:
    """``mandatory``: the best max(group size - base, 0) rows of each term; none without a base."""
    if base <= 0:
        return df.withColumn("mandatory", F.lit(False))
    ranked = first_rank(df, key, score, tie, "_r")
    return ranked.withColumn("mandatory", F.col("_r") <= F.greatest(F.col("term_size") - base, F.lit(0))).drop("_r", "term_size")


def rate_constrained(df: DataFrame, share: float, base: int, key: str = "term_id", score: str = "score", tie: str = "id") -> DataFrame:
    """Mandatory rows first, the rest of the budget by global score among the others; more
    mandatory rows than budget is an error."""
    _rate(share)
    marked = cut(mandatory_rows(df, base, key, score, tie))
    n, needed, allowed = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("mandatory").cast("long")), F.lit(0)), budget(F.count(F.lit(1)), F.lit(share))).first()
    if needed > allowed:
        raise ContractError(f"{needed} mandatory rows, budget {allowed}; the least rate is {needed / n:.6f}")
    rest = positions(marked.where("NOT mandatory"), score, tie, "_p").withColumn("prediction", (F.col("_p") <= allowed - needed).cast("int")).drop("_p")
    return rest.unionByName(marked.where("mandatory").withColumn("prediction", F.lit(1))).drop("mandatory")


def many_rates(df: DataFrame, rates: list[float], base: int = 0, **names: str) -> dict[str, DataFrame]:
    """One decision table per rate, by suffix ``r22`` and the like; ``names`` go to each decision."""
    return {rate_suffix(r): rate_constrained(df, r, base, **names) if base else rate(df, r, **{k: v for k, v in names.items() if k != "key"}) for r in rates}
