"""Ordered target statistics, trees over many categories, pair heads, and grids by histograms."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchrank.operators import encoding, grid, models


def _order(key, seed="ordered"):
    return int(hashlib.sha256(f"{seed}\x1f{key}".encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    # a third of all rows has one category; some have none, some keys come twice
    return [(k if k % 50 else 7, "hot" if k % 3 == 0 else None if k % 17 == 0 else f"c{rng.randrange(40)}", int(rng.random() < 0.3)) for k in range(900)]


def test_statistics_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "id long, kind string, label int").repartition(5)
    fitted = encoding.fit_statistics(df, ["kind"], strength=2.0)
    prior = sum(y for *_, y in rows) / len(rows)
    got = sorted((r.id, str(r.kind), r.label, round(r.kind_ts, 9)) for r in encoding.encode_training(df, fitted, "id").collect())
    mean = lambda ys: (sum(ys) + 2 * prior) / (len(ys) + 2)
    assert got == sorted((i, str(c), y, round(mean([z for j, d, z in rows if d == c and _order(j) < _order(i)]), 9)) for i, c, y in rows)
    after = {r.kind: r.kind_ts for r in fitted.encode(spark.createDataFrame([("hot",), (None,), ("unseen",)], "kind string")).collect()}
    assert after["unseen"] == pytest.approx(prior)
    for c in ("hot", None):
        assert after[c] == pytest.approx(mean([y for _, d, y in rows if d == c]))


def test_no_row_sees_its_own_label(spark, rows):
    """With one label turned over and the prior held, neither that row's statistic nor an earlier one's moves."""
    ids = [i for i, *_ in rows]
    once = [r for r in rows if ids.count(r[0]) == 1]
    target = next(r for r in once if r[1] == "hot")
    turned = [(i, c, 1 - y if i == target[0] else y) for i, c, y in once]
    held = encoding.TargetStatistics(0.3, 1.0, {"kind": None})
    values = [{r.id: r.kind_ts for r in encoding.encode_training(spark.createDataFrame(x, "id long, kind string, label int"), held, "id").collect()} for x in (once, turned)]
    moved = {i for i in values[0] if values[0][i] != values[1][i]}
    assert moved == {i for i, c, _ in once if c == "hot" and _order(i) > _order(target[0])}


@pytest.mark.parametrize("path", [None, "saved"])
def test_ten_thousand_categories_fit_and_tell(spark, tmp_path, path):
    """Categories decide the label; held-out rows are ranked by them, also by a model that was written and read."""
    df = spark.range(40_000).select(F.col("id"), F.concat(F.lit("c"), (F.col("id") % 10_000).cast("string")).alias("kind"), (F.rand(3)).alias("noise"), ((F.crc32((F.col("id") % 10_000).cast("string")) % 10) < 3).cast("int").alias("label"))
    train, test = df.where("id < 30000"), df.where("id >= 30000")
    fitted = models.train_trees(train, ["noise"], ["kind"], trees=3, depth=3)
    if path:
        models.save_model(fitted, f"file://{tmp_path}/{path}")
        fitted = models.load_model(f"file://{tmp_path}/{path}")
    assert models.importances(fitted)[0][0] == "kind"
    prob = models.predict(fitted, test).groupBy("label").agg(F.min("prob").alias("low"), F.max("prob").alias("high")).collect()
    by = {r.label: r for r in prob}
    assert by[1].low > by[0].high


def test_validation_rows_stay_out_of_the_statistics(spark):
    """With validation rows whose labels contradict their categories, training statistics don't move."""
    df = spark.range(400).select("id", (F.col("id") % 4).cast("string").alias("kind"), (F.col("id") % 4 == 0).cast("int").alias("label"), (F.col("id") >= 300).alias("held"), F.lit(0.0).alias("x"))
    turned = df.withColumn("label", F.when(F.col("held"), 1 - F.col("label")).otherwise(F.col("label")))
    a, b = (sorted(map(tuple, models.train_trees(d, ["x"], ["kind"], trees=2, depth=2, valid="held").statistics.tables["kind"].collect())) for d in (df, turned))
    assert a == b


@pytest.mark.parametrize("hidden", [None, 8])
def test_pair_heads_learn_and_weigh_classes(spark, hidden):
    """Pairs of equal sign are 1; with one positive in ten a balanced head still finds most of them."""
    rng = np.random.default_rng(2)
    data = []
    for k in range(600):
        q = rng.normal(size=4)
        data.append((q.tolist(), (q + rng.normal(scale=0.4, size=4)).tolist() if k % 10 == 0 else rng.normal(size=4).tolist(), int(k % 10 == 0)))
    df = spark.createDataFrame(data, "q array<double>, i array<double>, label int")
    got = models.predict_pair_head(models.train_pair_head(df, hidden=hidden), df).toPandas()
    assert (got[got.label == 1].prob > 0.5).mean() > 0.8 and (got[got.label == 0].prob < 0.5).mean() > 0.7


def _curve(rows, weights, rates, bases):
    """Plain Python: order, budget, counts."""
    out = {}
    n, positives = len(rows), sum(r["label"] for r in rows)
    for w, weighting in enumerate(weights):
        score = {r["id"]: round(sum(r[c] * x for c, x in weighting.items()), 12) for r in rows}
        for base in bases:
            must = set()
            for t in {r["term_id"] for r in rows} if base else ():
                own = sorted((r["id"] for r in rows if r["term_id"] == t), key=lambda i: (-score[i], i))
                must |= set(own[: max(len(own) - base, 0)])
            order = sorted(rows, key=lambda r: (r["id"] not in must, -score[r["id"]], r["id"]))
            for rate in rates:
                predicted = round(n * rate)
                if len(must) <= predicted:
                    tp = sum(r["label"] for r in order[:predicted])
                    half = lambda hit, a, b: 2 * hit / (2 * hit + a + b) if 2 * hit + a + b else 0
                    fp, fn = predicted - tp, positives - tp
                    out[w, base, rate] = (round(0.5 * (half(tp, fp, fn) + half(n - positives - fp, fp, fn)), 12), len(must))
    return out


@pytest.mark.parametrize(("chunk", "bases"), [(1 << 16, [0, 5, 30]), (8, [0, 1])])
def test_grid_equals_brute_force(spark, monkeypatch, chunk, bases):
    """Ties, one term with a third of all rows, a constant component; terms in one chunk and in many."""
    monkeypatch.setattr(grid, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [{"id": f"r{k:04d}", "term_id": 0 if k % 3 == 0 else rng.randrange(1, 25), "a": rng.choice([0.1, 0.5, rng.random()]), "b": rng.choice([0.25, rng.random()]), "c": 0.5, "label": int(rng.random() < 0.3)} for k in range(260)]
    weights = [{"a": 1.0, "b": 0.0, "c": 0.0}, {"a": 0.0, "b": 0.0, "c": 1.0}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 0.25, "b": 0.75, "c": 0.0}]
    rates = [0.004, 0.1, 0.2, 0.35, 0.5, 0.77, 0.999]
    got = grid.grid_curve(spark.createDataFrame(rows), weights, rates, bases).collect()
    assert {(r.weight_id, r.base, r.rate): (round(r.macro_f1, 12), r.mandatory_count) for r in got} == _curve(rows, weights, rates, bases)
    assert grid.grid_curve(spark.createDataFrame(rows).where("false"), weights, rates, [0]).count() == 0
