"""Aligning, rank-normalizing and blending scores; recipes over a grid of weights (``grid``)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchrank.functions.numeric import simplex_weights
from matchrank.operators.grid import grid_curve
from matchrank.operators.lineage import cut
from matchrank.operators.ranking import rank_pct
from matchrank.sources.contracts import ContractError, require_rows, require_unique


def align(parts: dict[str, DataFrame], expected: int | None = None, check: bool = True) -> DataFrame:
    """Inner join of ``id, term_id, score`` tables to ``id, term_id, <name>...``; one term per id."""
    if check:
        ids = reduce(lambda a, b: a.unionByName(b), [df.select("id", F.lit(name).alias("component")) for name, df in parts.items()])
        require_unique(ids, "component", "id")
    named = [df.select("id", F.col("term_id").alias(f"_t{k}"), F.col("score").alias(name)) for k, (name, df) in enumerate(parts.items())]
    out = reduce(lambda a, b: a.join(b, "id"), named)
    if check and len(named) > 1:
        out = cut(out)  # the join runs once for the check and for what follows
        differ = reduce(lambda a, b: a | b, [F.col("_t0") != F.col(f"_t{k}") for k in range(1, len(named))])
        if n := out.where(differ).count():
            raise ContractError(f"{n} ids with different terms")
    out = out.select("id", F.col("_t0").alias("term_id"), *parts)
    return require_rows(out, expected) if expected is not None else out


def weighted(names: dict[str, float]) -> Column:
    """Weighted mean of columns; the weights' sum must be positive."""
    total = sum(names.values())
    if total <= 0:
        raise ContractError("weights must have a positive sum")
    return reduce(lambda a, b: a + b, [F.col(n) * (w / total) for n, w in names.items() if w])


def ranked(df: DataFrame, names: list[str], scope: str | None) -> DataFrame:
    """Each column replaced by its percentile rank over ``scope`` (a key), or over the table."""
    for n in names:
        df = rank_pct(df, n, f"_{n}", *([scope] if scope else [])).drop(n).withColumnRenamed(f"_{n}", n)
    return df


def two_level(aligned: DataFrame, trees: dict[str, float], model: str, share: float = 0.5, scope: str | None = "term_id", rerank: bool = True, digits: int = 9) -> DataFrame:
    """Ranks of the tree scores are blended, ranked again and blended with the model's ranks. Blends are
    rounded to ``digits`` before they are ranked, so that equal ones tie."""
    out = ranked(aligned, [*trees, model], scope).withColumn("trees", F.round(weighted(trees), digits))
    if rerank:
        out = ranked(out, ["trees"], scope)
    return out.withColumn("score", weighted({"trees": share, model: 1 - share}))


def best_point(curve: DataFrame) -> DataFrame:
    """Best macro-F1, then the smallest weighting, base and rate."""
    return curve.orderBy(F.round("macro_f1", 12).desc(), "weight_id", "base", "rate").limit(1)


def combine_folds(parts: list[DataFrame], extra: DataFrame | None = None) -> DataFrame:
    """Union of fold scores with distinct ``slate_id``, joined one to one with further scores."""
    out = require_unique(reduce(lambda a, b: a.unionByName(b), parts), "slate_id")
    if extra is not None:
        require_unique(extra, "slate_id")
        if n := out.join(extra, "slate_id", "left_anti").count():
            raise ContractError(f"{n} rows without extra scores")
        out = out.join(extra, "slate_id")
    return out


def best_recipe(aligned: DataFrame, names: list[str], rates: list[float], step: float, required: tuple[str, ...] = (), scope: str = "fold", tie: str = "id") -> DataFrame:
    """The best weighting of the named scores in one row: ``macro_f1, positive_rate, weights`` (JSON).

    Scores are ranked per ``scope``; weightings run over the simplex in multiples of ``step``, those that give
    a required score no weight are left out. Ties go to the first weighting, then the smallest rate.
    """
    weights = [w for w in simplex_weights(names, step) if all(w[r] > 0 for r in required)]
    if not weights:
        raise ContractError("no weighting is left")
    curve = grid_curve(ranked(aligned, names, scope), weights, rates, [0], tie)
    listed = F.create_map(*[x for k, w in enumerate(weights) for x in (F.lit(k), F.lit(json.dumps(w, sort_keys=True)))])
    return best_point(curve).select("macro_f1", F.col("rate").alias("positive_rate"), F.try_element_at(listed, F.col("weight_id")).alias("weights"))


def select_recipe(recipes: DataFrame) -> DataFrame:
    """Of ``recipe, macro_f1, recall, ...`` the best macro-F1, then the best recall, then the first name."""
    return recipes.orderBy(F.col("macro_f1").desc(), F.col("recall").desc(), "recipe").limit(1)


def blend_two(first: DataFrame, second: DataFrame, share: float = 0.65, scope: str | None = None) -> DataFrame:
    """``id, term_id, score``: percentile ranks of two score tables, mixed ``share`` to the first."""
    out = ranked(align({"first": first, "second": second}), ["first", "second"], scope)
    return out.select("id", "term_id", weighted({"first": share, "second": 1 - share}).alias("score"))
