"""Learned scorers on ``pyspark.ml``: gradient-boosted trees, logistic pair heads, out-of-fold runs."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchrank.functions.numeric import dot
from matchrank.operators.encoding import TargetStatistics, encode_training, fit_statistics
from matchrank.operators.features import model_frame
from matchrank.operators.lineage import cut
from matchrank.operators.metrics import best_rate, rate_curve
from matchrank.operators.splits import inner_split


def _balanced(rows: DataFrame, label: str) -> DataFrame:
    n, pos = rows.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
    pos = pos or 0.0
    weight = F.when(F.col(label) == 1, n / 2 / max(pos, 1.0)).otherwise(n / 2 / max(n - pos, 1.0))
    return rows.withColumn("_w", weight)


def _repeated(rows: DataFrame, label: str) -> DataFrame:
    """Rows of the rarer class as often as the other class outnumbers it, rounded."""
    n, pos = rows.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("long"))).first()
    pos = pos or 0
    ones, zeros = (max(1, round((n - pos) / pos)), 1) if 0 < pos <= n - pos else (1, max(1, round(pos / max(n - pos, 1))))
    times = F.when(F.col(label) == 1, F.lit(ones)).otherwise(F.lit(zeros))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).drop("_copy")


@dataclass
class Trees:
    """Boosted trees with the statistics that turn their categorical columns into numbers."""

    model: PipelineModel
    statistics: TargetStatistics


def train_trees(
    rows: DataFrame, numeric: list[str], categorical: list[str] = (), label: str = "label", trees: int = 30, depth: int = 4, seed: int = 42, valid: str | None = None, tolerance: float = 0.001, key: str = "id", strength: float = 1.0
) -> Trees:
    """Balanced boosted trees over numeric columns and categories of any number.

    A category enters as an ordered target statistic (``encoding``), in an order by the hash of ``key``,
    which names a row; unseen ones get the prior. With ``valid``, a boolean column, those rows are held
    out, from the statistics too, and boosting stops once a further tree betters their error by less than
    ``tolerance``.
    """
    known = rows.where(~F.col(valid)) if valid else rows
    statistics = fit_statistics(known, list(categorical), label, strength)
    encoded = encode_training(known, statistics, key, label)
    if valid:
        encoded = encoded.unionByName(statistics.encode(rows.where(valid)))
    vector = VectorAssembler(inputCols=[*numeric, *(f"{c}_ts" for c in categorical)], outputCol="_x", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=trees, maxDepth=depth, seed=seed)
    if valid:
        gbt = gbt.setValidationIndicatorCol(valid).setParams(validationTol=tolerance)
    return Trees(Pipeline(stages=[vector, gbt]).fit(_balanced(cut(encoded), label)), statistics)


def predict(trees: Trees, rows: DataFrame, out: str = "prob") -> DataFrame:
    """``rows`` with the probability of class 1; the model runs where the rows are."""
    scored = trees.model.transform(trees.statistics.encode(rows).withColumn("_w", F.lit(1.0))).withColumn(out, F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(*rows.columns, out)


def importances(trees: Trees) -> list[tuple[str, float]]:
    """Feature importances, largest first; a category goes by its column's name."""
    names = [n[:-3] if n.endswith("_ts") and n[:-3] in trees.statistics.tables else n for n in trees.model.stages[-2].getInputCols()]
    return sorted(zip(names, map(float, trees.model.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def pair_head(q: Column, i: Column) -> dict[str, Column]:
    """Inputs of the pair head: both vectors, absolute difference, product and their dot."""
    return {
        "head_diff": F.zip_with(q, i, lambda a, b: F.abs(a - b)),
        "head_product": F.zip_with(q, i, lambda a, b: a * b),
        "head_dot": dot(q, i),
    }


def train_pair_head(rows: DataFrame, label: str = "label", hidden: int | None = None, seed: int = 42) -> PipelineModel:
    """A balanced head over ``q, i`` array columns and the derived ones: logistic or, with ``hidden``
    units, a perceptron with one hidden layer. That one takes no row weights: rows of the rarer class are
    repeated as often as their weight says, which is the same sum of losses up to rounding of the ratio."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import SQLTransformer
    from pyspark.ml.functions import array_to_vector

    wide = with_head(rows).withColumn("_x", array_to_vector("_a"))
    if hidden:
        width = wide.select(F.size("_a")).first()[0]
        model = MultilayerPerceptronClassifier(featuresCol="_x", labelCol=label, layers=[width, hidden, 2], maxIter=60, seed=seed).fit(_repeated(wide, label))
    else:
        model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=1e-3, maxIter=30).fit(_balanced(wide, label))
    return PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__"), model])


def with_head(rows: DataFrame) -> DataFrame:
    """``_a``: the concatenated head inputs as one array of doubles."""
    parts = pair_head(F.col("q"), F.col("i"))
    return rows.withColumn("_a", F.concat(F.col("q"), F.col("i"), parts["head_diff"], parts["head_product"], F.array(parts["head_dot"])).cast("array<double>"))


def predict_pair_head(model: PipelineModel, rows: DataFrame, out: str = "prob") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    scored = model.transform(with_head(rows).withColumn("_x", array_to_vector("_a")).withColumn("_w", F.lit(1.0)))
    return scored.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).select(*rows.columns, out)


def out_of_fold(rows: DataFrame, folds: int, numeric: list[str], categorical: list[str] = (), **options) -> DataFrame:
    """Each fold scored by a model of the others: ``rows`` with ``fold`` and ``prob``.

    Models are separate jobs, one per fold; the scores are one union. A fold without rows of both
    classes outside it raises, as nothing can be learned there.
    """
    parts = []
    for k in range(folds):
        train = rows.where(F.col("fold") != k)
        if train.select("label").distinct().count() < 2:
            raise ValueError(f"fold {k}: one class outside it")
        parts.append(predict(train_trees(train, numeric, categorical, **options), rows.where(F.col("fold") == k)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def fold_with_prior(pairs: DataFrame, fold: int, terms: DataFrame, items: DataFrame, priors, numeric: list[str], categorical: list[str] = (), ratios: bool = True, **options) -> DataFrame:
    """Scores of one fold: ``id, fold, label, prob``. Nothing of the held-out terms is learned from.

    ``pairs`` is ``id, term_id, item_id, label, fold``. ``priors`` maps positives of the other folds to
    ranked classes per level; model frames of both sides are made with them, an inner part of the
    training terms stops the boosting. ``ratios`` takes the three fuzzy ratios into the frames.
    """
    train, held = pairs.where(F.col("fold") != fold), pairs.where(F.col("fold") == fold)
    ranked = priors(train.where("label = 1").select("term_id", "item_id"))
    frame = lambda rows: model_frame(rows, terms, items, ranked, ratios=ratios)
    model = train_trees(inner_split(frame(train)), numeric, categorical, valid="is_valid", **options)
    return predict(model, frame(held)).select("id", "fold", "label", "prob")


def out_of_fold_with_prior(pairs: DataFrame, folds: int, terms: DataFrame, items: DataFrame, priors, numeric: list[str], categorical: list[str] = (), **options) -> DataFrame:
    """All folds of ``fold_with_prior`` in one table."""
    return reduce(lambda a, b: a.unionByName(b), [fold_with_prior(pairs, k, terms, items, priors, numeric, categorical, **options) for k in range(folds)])


def save_model(trees: Trees, path: str) -> None:
    """Write fitted trees as an artifact, statistics included; ``load_model`` reads it anywhere."""
    spark = SparkSession.getActiveSession()
    trees.model.write().overwrite().save(f"{path}/model")
    facts = {"prior": trees.statistics.prior, "strength": trees.statistics.strength, "columns": list(trees.statistics.tables)}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/statistics")
    for k, table in enumerate(trees.statistics.tables.values()):
        table.write.mode("overwrite").parquet(f"{path}/column-{k}")


def load_model(path: str) -> Trees:
    spark = SparkSession.getActiveSession()
    facts = json.loads(spark.read.text(f"{path}/statistics").first()[0])
    tables = {name: spark.read.parquet(f"{path}/column-{k}") for k, name in enumerate(facts["columns"])}
    return Trees(PipelineModel.load(f"{path}/model"), TargetStatistics(facts["prior"], facts["strength"], tables))


def validated_rate(rows: DataFrame, rates: list[float], share: float = 0.2) -> DataFrame:
    """The best rate on an inner grouped validation part of scored rows."""
    return best_rate(rate_curve(inner_split(rows, share).where("is_valid").drop("is_valid"), rates))
