"""Validation slates: retrieved candidates joined with all positives, one group per term."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchrank.operators.features import candidate_sources
from matchrank.operators.lineage import cut, sorted_join
from matchrank.operators.negatives import uniform
from matchrank.operators.ranking import rank_pct


def slate_ids(rows: DataFrame, prefix: str, term: str = "term_id", *order: str) -> DataFrame:
    """``slate_id`` numbered by term and order: per-term places plus the sizes of earlier terms."""
    place = F.row_number().over(Window.partitionBy(term).orderBy(*order))
    sizes = rows.groupBy(term).agg(F.count(F.lit(1)).alias("_n"))
    # one row per term
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy(term).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.withColumn("_p", place).join(sorted_join(offsets), term).withColumn("slate_id", F.format_string(f"{prefix}_%010d", F.col("_off") + F.col("_p") - 1)).drop("_p", "_off")


def lexical_slate(ranked: DataFrame, positives: DataFrame, folds: DataFrame) -> DataFrame:
    """Retrieved rows (``term_id, item_id, score, rank``) united with positives, per fold.

    Positives that retrieval missed follow by item id with rank 0 and score 0.
    """
    pos = positives.select("term_id", "item_id").withColumn("label", F.lit(1))
    rows = ranked.select("term_id", "item_id", "score", "rank").join(pos, ["term_id", "item_id"], "full_outer")
    rows = rows.join(sorted_join(folds.select("term_id", "fold")), "term_id").withColumns(
        {"label": F.coalesce("label", F.lit(0)), "retrieval_rank": F.coalesce("rank", F.lit(0)), "retrieval_score": F.coalesce("score", F.lit(0.0)), "is_retrieved": F.when(F.coalesce("rank", F.lit(0)) > 0, 1).otherwise(0)}
    )
    rows = rows.withColumn("candidate_count", F.count(F.lit(1)).over(Window.partitionBy("term_id"))).withColumn("_last", 1 - F.col("is_retrieved"))
    out = slate_ids(rows, "OOF", "term_id", "_last", "retrieval_rank", "item_id")
    return out.select("slate_id", "term_id", "item_id", "fold", "label", "candidate_count", "is_retrieved", "retrieval_rank", "retrieval_score")


def hybrid_slate(
    lexical: DataFrame, embedding: DataFrame, positives: DataFrame, items: DataFrame, folds: DataFrame, cosine: Callable[[DataFrame], DataFrame], first: int = 40, uniform_rows: int = 20, seed: str = "slate"
) -> DataFrame:
    """First rows of both retrievals, uniform rows and missing positives, in that order, once each.

    ``cosine`` maps the pairs ``query_id, item_id`` of the slate to ``query_id, item_id, similarity``: every candidate
    is scored, wherever it comes from, and ranked by that within its term. A catalog too small for
    the uniform rows is an error.
    """
    lex = lexical.where(F.col("rank") <= first).select("term_id", "item_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    emb = embedding.where(F.col("rank") <= first).select("term_id", "item_id", F.col("rank").alias("embedding_rank"))
    pos = positives.select("term_id", "item_id").withColumn("label", F.lit(1))
    found = lex.join(emb, ["term_id", "item_id"], "full_outer")
    taken = found.select("term_id", "item_id").unionByName(pos.select("term_id", "item_id")).distinct()
    uni = uniform(taken, items, uniform_rows, seed).select("term_id", "item_id", F.col("pick").alias("uniform_pick"))
    rows = found.join(uni, ["term_id", "item_id"], "full_outer").join(pos, ["term_id", "item_id"], "full_outer")
    rows = cut(rows)  # scored and joined with its scores
    scores = cosine(rows.select(F.col("term_id").alias("query_id"), "item_id"))
    scored = scores.select(F.col("query_id").alias("term_id"), "item_id", F.round("similarity", 9).alias("semantic_cosine"))
    rows = rows.join(sorted_join(scored), ["term_id", "item_id"]).join(sorted_join(folds.select("term_id", "fold")), "term_id")
    has = {"tfidf": F.col("lexical_rank").isNotNull(), "embedding": F.col("embedding_rank").isNotNull(), "uniform": F.col("uniform_pick").isNotNull()}
    only = ~has["tfidf"] & ~has["embedding"] & ~has["uniform"]
    rows = rows.withColumns(
        {
            "label": F.coalesce("label", F.lit(0)),
            "candidate_sources": candidate_sources({**has, "positive_union": only}),
            "is_retrieved": F.when(has["tfidf"] | has["embedding"], 1).otherwise(0),
            "retrieval_rank": F.coalesce("lexical_rank", F.lit(0)),
            "retrieval_score": F.coalesce("lexical_score", F.lit(0.0)),
            "candidate_count": F.count(F.lit(1)).over(Window.partitionBy("term_id")),
            "_a": F.when(has["tfidf"], 0).when(has["embedding"], 1).when(has["uniform"], 2).otherwise(3),
            "_b": F.coalesce("lexical_rank", "embedding_rank", "uniform_pick", F.lit(0)),
        }
    )
    rows = rank_pct(rows, "semantic_cosine", "semantic_rank_pct", "term_id")
    out = slate_ids(rows, "HYBRID", "term_id", "_a", "_b", "item_id")
    return out.select("slate_id", "term_id", "item_id", "fold", "label", "candidate_count", "is_retrieved", "retrieval_rank", "retrieval_score", "candidate_sources", "semantic_cosine", "semantic_rank_pct")
