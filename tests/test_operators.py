import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchrank.operators import blend, category, decisions, features, manifests, metrics, models, negatives, ranking, retrieval, slates, splits
from matchrank.sources import contracts, tables
from matchrank.sources.contracts import ContractError


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": np.arange(3000), "term_id": rng.integers(0, 40, 3000), "score": rng.integers(0, 90, 3000) / 10.0})
    pdf.loc[:1000, "score"] = 4.2  # a third of the rows share one score
    pdf["label"] = (rng.random(3000) < pdf.score / 10).astype(int)
    return spark.createDataFrame(pdf).cache(), pdf


def test_positions_and_percentile_ranks(scored):
    df, pdf = scored
    want = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True).id
    got = {r.position: r.id for r in ranking.positions(df, "score", "id").collect()}
    assert [got[k + 1] for k in range(len(want))] == want.tolist()
    for keys in ((), ("term_id",)):
        got = ranking.rank_pct(df, "score", "p", *keys).toPandas().set_index("id").p.sort_index()
        base = pdf.groupby(list(keys)).score if keys else pdf.score
        assert np.allclose(got, base.rank(method="average", pct=True))


def test_bins_and_describe(scored):
    df, pdf = scored
    got = ranking.quantile_bins(df, "score", "id", 7).toPandas().set_index("id").bin.sort_index()
    order = pdf.sort_values(["score", "id"]).index
    want = pd.Series(pd.qcut(pd.Series(np.arange(1, len(pdf) + 1)), 7, labels=False).to_numpy(), index=order).sort_index()
    assert (got.to_numpy() == want.to_numpy()).all()
    row = ranking.describe(df, "score").first()
    assert row["std"] == pytest.approx(pdf.score.std()) and row.p25 == pytest.approx(pdf.score.quantile(0.25))


def _decide(pdf, n_pos, base):
    rank = pdf.sort_values(["score", "id"], ascending=[False, True]).groupby("term_id").cumcount() + 1
    size = pdf.groupby("term_id").score.transform("size")
    must = rank.sort_index() <= (size - base).clip(lower=0) if base else pd.Series(False, index=pdf.index)
    rest = pdf[~must].sort_values(["score", "id"], ascending=[False, True]).head(n_pos - must.sum()).index
    out = must.astype(int)
    out[rest] = 1
    return out


def test_rate_decisions_and_curve(scored):
    df, pdf = scored
    for base in (0, 60):
        got = decisions.rate_constrained(df, 0.5, base).toPandas().set_index("id").prediction.sort_index()
        assert (got == _decide(pdf, round(len(pdf) * 0.5), base)).all()
        curve = {r.rate: r for r in metrics.rate_curve(df, [0.001, 0.5, 0.625], base).collect()}
        assert (0.001 in curve) == (base == 0)
        for rate in (0.5, 0.625):
            p = _decide(pdf, round(len(pdf) * rate), base)
            f = [2 * ((p == c) & (pdf.label == c)).sum() / ((p == c).sum() + (pdf.label == c).sum()) for c in (0, 1)]
            assert curve[rate].macro_f1 == pytest.approx(np.mean(f))
    assert decisions.rate(df, 0.22).agg(F.sum("prediction")).first()[0] == 660
    with pytest.raises(ContractError):
        decisions.rate_constrained(df, 0.01, 10)
    with pytest.raises(ContractError):
        decisions.rate(df, 1.0)


def test_thresholds(scored):
    df, pdf = scored
    out = decisions.threshold_per_term(df, 8.5, 2, 3, 5.0).toPandas()
    per = out.groupby("term_id").prediction.sum()
    assert per.max() <= 3 and per.min() >= 2
    scan = metrics.threshold_scan(df, 0.0, 9.0, 0.5).toPandas()
    assert scan[scan.threshold == 4.5].predicted.item() == (pdf.score >= 4.5).sum()


def test_folds_and_splits(spark):
    pairs = spark.createDataFrame([(f"t{t}", f"i{t}-{k}") for t in range(25) for k in range(1 + t % 7)], "term_id string, item_id string")
    folds = splits.term_folds(pairs).toPandas()
    assert len(folds) == folds.term_id.nunique() == 25 and set(folds.fold) == set(range(5))
    assert folds.fold.value_counts().max() - folds.fold.value_counts().min() <= 1
    assert (splits.split_manifest(pairs, "pilot").toPandas().split == "outer_holdout").sum() == 5
    assert set(splits.split_manifest(pairs, "final").toPandas().fold) == {-1}
    train, held = splits.hold_out(pairs, splits.split_manifest(pairs, "confirm"), 2)
    contracts.require_disjoint(train, held, "term_id")
    marks = splits.inner_split(pairs, 0.2).toPandas().groupby("term_id").is_valid.nunique()
    assert (marks == 1).all()


def test_dense_top_k_equals_full_product(spark):
    rng = np.random.default_rng(10)
    q, x = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(7, 13)), rng.normal(size=(31, 13))))
    frame = lambda v, key: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], f"{key} long, vector array<double>")
    got = retrieval.dense_top_k(frame(q, "query_id"), frame(x, "item_id"), 9, block=8).toPandas()
    full = np.round(q @ x.T, 9)
    for k in range(7):
        want = np.lexsort((np.arange(31), -full[k]))[:9]
        assert got[got.query_id == k].sort_values("rank").item_id.tolist() == want.tolist()


@pytest.fixture(scope="module")
def world(spark):
    n = 140
    items = spark.createDataFrame([(f"i{i:03d}", f"title {i} word{i % 13}", f"cat{i % 7}/sub{i % 3}", f"brand{i % 11}", "", "", f"attr {i % 5}") for i in range(n)], tables.ITEMS)
    terms = spark.createDataFrame([(f"t{t}", f"title {t} word{t % 13}") for t in range(10)], tables.TERMS)
    positives = spark.createDataFrame([(f"t{t}", f"i{t:03d}") for t in range(10)], "term_id string, item_id string")
    pool = terms.select("term_id").crossJoin(items.select("item_id")).withColumn("rank", F.row_number().over(Window.partitionBy("term_id").orderBy(F.sha2(F.concat("term_id", "item_id"), 256)))).withColumn("score", 1.0 / F.col("rank"))
    return items, terms, positives, pool.cache()


def test_negatives(spark, world):
    items, terms, positives, pool = world
    facts = items.select("item_id", "title", "brand", F.split("title", " ").alias("tokens"))
    second = pool.withColumn("rank", 141 - F.col("rank"))
    rows = negatives.rank_band_negatives(pool, second, positives, facts, 21, 80, 10, uniform_rows=5).cache()
    negatives.check_negatives(rows, positives, 21, 80)
    counts = rows.groupBy("term_id", "negative_source").count().toPandas()
    assert counts[counts.negative_source == "uniform"]["count"].tolist() == [5] * 10
    assert rows.groupBy("term_id").count().toPandas()["count"].tolist() == [25] * 10
    kept = sorted(map(tuple, rows.collect()))
    spark.catalog.clearCache()
    assert sorted(map(tuple, negatives.rank_band_negatives(pool, second, positives, facts, 21, 80, 10, uniform_rows=5).collect())) == kept
    short = negatives.rank_band_negatives(pool.where("rank < 25"), second.where("rank < 25"), positives, facts, 21, 80, 10)
    got = short.toPandas()
    assert got.negative_source.str.startswith("uniform_backfill").any() and (got.groupby("term_id").size() == 20).all()
    bands = negatives.tfidf_bands(pool.where("rank <= 60"), positives, items).groupBy("negative_band").count().toPandas().set_index("negative_band")["count"]
    assert bands.to_dict() == {"hard": 250, "mid": 150, "easy": 100}


def test_slates(spark, world):
    items, terms, positives, pool = world
    folds = splits.term_folds(positives)
    slate = slates.lexical_slate(pool.where("rank <= 20"), positives, folds).toPandas()
    assert slate.label.sum() == 10 and slate.slate_id.is_unique and (slate.groupby("term_id").candidate_count.first() == slate.groupby("term_id").size()).all()
    hybrid = slates.hybrid_slate(pool, pool.withColumn("rank", 141 - F.col("rank")), positives, items, folds, lambda pairs: pairs.withColumn("similarity", F.length("item_id") / 8 + F.crc32("item_id") / 2**34)).toPandas()
    assert hybrid.label.sum() == 10 and hybrid.slate_id.is_unique and (hybrid.groupby("term_id").size() >= 100).all()


def test_features_category_models(spark, world):
    items, terms, positives, _ = world
    pairs = terms.select("term_id").crossJoin(items.select("item_id")).withColumn("id", F.concat_ws("#", "term_id", "item_id"))
    best = ranking.top_k(features.score_pairs(pairs, terms, items), "term_id", "score", "item_id", 1).join(positives, ["term_id", "item_id"], "left_semi")
    assert best.count() == 10
    examples = category.category_examples(positives, terms, items)
    asked = terms.withColumn("query_norm", F.col("query"))
    prior = category.count_prior(examples, asked, "cat_l1", F.split("query_norm", " "))
    wide = category.wide_top(prior, "cat_l1").toPandas()
    assert len(wide) == 10 and wide.cat_l1_prob1.notna().all()
    rows = features.pair_features(features.join_pairs(pairs, terms, items), ratios=False).join(positives.withColumn("label", F.lit(1)), ["term_id", "item_id"], "left").fillna(0, ["label"]).withColumn("kind", F.col("brand"))
    model = models.train_trees(rows, ["full_cov", "title_cov"], ["kind"], trees=3, depth=2)
    assert models.importances(model)[0][0] in ("full_cov", "title_cov")
    assert models.predict(model, rows).where("prob > 0.5 AND label = 1").count() == 10


def test_blends(spark, scored):
    df, pdf = scored
    parts = {"a": df.select("id", "term_id", "score"), "b": df.select("id", "term_id", (-F.col("score")).alias("score"))}
    out = blend.two_level(blend.align(parts, expected=3000).withColumn("c", F.col("a")), {"a": 0.7, "b": 0.3}, "c")
    assert out.count() == 3000
    with pytest.raises(ContractError):
        blend.align({"a": parts["a"], "b": parts["b"].withColumn("term_id", F.col("term_id") + 1)})
    with pytest.raises(ContractError):
        blend.weighted({"a": 0.0})


def test_contracts_sources_caches(spark, tmp_path):
    assert tables.parse_component("x=/a:b.csv:prob") == ("x", "/a:b.csv", "prob")
    (tmp_path / "t.csv").write_text('term_id,query\n1,"a ""b"", c"\n2,\n3,NA\n')
    assert [r.query for r in tables.read_csv(spark, str(tmp_path / "t.csv"), tables.TERMS).orderBy("term_id").collect()] == ['a "b", c', "", "NA"]
    assert [r.query for r in tables.read_csv(spark, str(tmp_path / "t.csv"), tables.TERMS, blanks=False).orderBy("term_id").collect()] == ['a "b", c', None, None]
    twice = spark.createDataFrame([("1", "t", "0.5"), ("1", "t", "0.6")], "id string, term_id string, prob string")
    with pytest.raises(ContractError):
        tables.score_table(twice)
    with pytest.raises(ContractError):
        tables.score_table(twice.limit(1).withColumn("prob", F.lit("x")))
    cache = manifests.StageCache(spark, str(tmp_path / "c"), {"a": 1})
    assert cache.get("s", lambda: spark.range(3)).count() == 3
    assert cache.get("s", lambda: spark.range(5)).count() == 3
    with pytest.raises(ContractError):
        manifests.StageCache(spark, str(tmp_path / "c"), {"a": 2}).get("s", lambda: spark.range(5))


def test_stream_equals_batch(spark, tmp_path, world):
    from matchrank.streaming.scoring import pair_stream, score_stream

    items, terms, positives, _ = world
    pairs = positives.select(F.concat_ws("#", "term_id", "item_id").alias("id"), "term_id", "item_id")
    pairs.repartition(3).write.csv(str(tmp_path / "in"), header=True)
    score_stream(pair_stream(spark, str(tmp_path / "in")), terms, items, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    batch = features.score_pairs(pairs, terms, items, ratios=False)
    assert spark.read.parquet(str(tmp_path / "out")).select(batch.columns).exceptAll(batch).count() == 0


def test_positions_of_string_ties_and_nulls(spark):
    rows = [(f"SLATE_{k:06d}", None if k % 7 == 0 else float(k % 3)) for k in range(500)]
    df = spark.createDataFrame(rows, "id string, score double").repartition(6)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = sorted((r.p, r.id) for r in ranking.positions(df, "score", "id", "p").collect())
    assert got == [(k + 1, r[0]) for k, r in enumerate(want)]
    assert decisions.rate(df, 0.2).agg(F.sum("prediction")).first()[0] == 100
    ranks = ranking.rank_pct(df, "score", "r").toPandas().set_index("id").r.sort_index()
    plain = pd.DataFrame(rows, columns=["id", "score"]).set_index("id").score.rank(pct=True).sort_index()
    assert ranks.isna().equals(plain.isna()) and np.allclose(ranks.dropna(), plain.dropna())
    assert ranking.positions(df.where("false"), "score", "id").count() == 0


def test_exact_quantiles(spark):
    values = [1.0] * 700 + [float(k) for k in range(300)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    probs = {f"q{k}": p for k, p in enumerate((0.0, 0.013, 0.5, 0.7505, 0.99, 1.0))}
    got = ranking.quantiles(df, "v", probs).first()
    plain = pd.Series(values).dropna()
    assert [got[n] for n in probs] == pytest.approx([plain.quantile(p) for p in probs.values()])
    assert ranking.quantiles(df.where("v IS NULL"), "v", {"m": 0.5}).first().m is None


def test_sparse_space_against_numpy(spark):
    """Top-k with a feature that all items have, ties, a cut vocabulary, and pairs scored later."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(["all", *rng.choice(words, n)])
    q, x = {f"q{k}": text(4) for k in range(9)}, {k: text(8) for k in range(70)}
    x[70] = x[3]
    qf, xf = spark.createDataFrame(list(q.items()), "query_id string, text string"), spark.createDataFrame(list(x.items()), "item_id long, text string")
    split = lambda c: F.split(c, " ")
    for limit in (None, 15):
        docs = [t.split() for t in (*q.values(), *x.values())]
        df, total = {}, {}
        for d in docs:
            for w in d:
                total[w] = total.get(w, 0) + 1
            for w in set(d):
                df[w] = df.get(w, 0) + 1
        vocab = sorted((w for w in df if df[w] > 1), key=lambda w: (-total[w], w))[:limit]
        vec = lambda t: np.array([(1 + np.log(t.split().count(w))) * (np.log((1 + len(docs)) / (1 + df[w])) + 1) if w in t.split() else 0.0 for w in vocab])  # noqa: B023, E731
        unit = lambda v: v / (np.linalg.norm(v) or 1)
        full = {(a, b): float(unit(vec(s)) @ unit(vec(t))) for a, s in q.items() for b, t in x.items()}
        got = retrieval.tfidf_top_k(qf, xf, split, 10, 2, limit).collect()
        for a in q:
            want = sorted(x, key=lambda b: (-round(full[a, b], 9), b))[:10]
            assert [r.item_id for r in sorted((r for r in got if r.query_id == a), key=lambda r: r.rank)] == want
        space = retrieval.fit_tfidf([(qf, "query_id"), (xf, "item_id")], split, 2, limit)
        pairs = spark.createDataFrame([("q1", 5), ("q2", 70), ("q2", 70), ("q3", 999)], "query_id string, item_id long")
        sims = {(r.query_id, r.item_id): r.similarity for r in retrieval.pair_similarity(pairs, space.transform(qf, "query_id"), space.transform(xf, "item_id")).collect()}
        assert sims == pytest.approx({("q1", 5): full["q1", 5], ("q2", 70): full["q2", 70], ("q3", 999): 0.0})
    few = retrieval.tfidf_top_k(qf, xf.where("item_id < 5"), split, 10).withColumn("rank", F.col("rank"))
    padded = retrieval.pad_with_random(few, qf, xf, 20).toPandas()
    assert (padded.groupby("query_id").size() == 20).all() and not padded.duplicated(["query_id", "item_id"]).any()
    assert all(g["rank"].tolist() == list(range(1, 21)) for _, g in padded.sort_values("rank").groupby("query_id"))


def test_sources_by_position_and_defaults(spark):
    a, b = spark.createDataFrame([(3,), (1,), (2,)], "k int"), spark.createDataFrame([(10, "x"), (30, "z"), (20, "y")], "at int, v string")
    assert sorted(map(tuple, tables.zip_by_position(a, b, "k", "at", ["v"]).collect())) == [(1, "x"), (2, "y"), (3, "z")]
    with pytest.raises(ContractError):
        tables.zip_by_position(a, b.limit(2), "k", "at", ["v"])
    with pytest.raises(ContractError):
        tables.positive_pairs(spark.createDataFrame([("t", "i", "0")], "term_id string, item_id string, label string"))
    with pytest.raises(ContractError):
        negatives.external_negatives(a.selectExpr("k term_id", "k item_id"), a.selectExpr("k term_id", "k item_id"))
    assert decisions.many_rates(spark.range(100).withColumn("score", F.rand(1)), [0.145, 0.5]).keys() == {"r14", "r50"}


def test_recipes(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(400), "term_id": rng.integers(0, 9, 400), "fold": rng.integers(0, 2, 400), "a": rng.random(400), "b": rng.random(400)})
    pdf["label"] = (pdf.a + 0.1 * pdf.b > 0.8).astype(int)
    best = blend.best_recipe(spark.createDataFrame(pdf), ["a", "b"], [0.2, 0.25, 0.3], 0.25, required=("b",)).first()
    assert best.weights == '{"a": 0.75, "b": 0.25}' or best.weights == '{"a": 0.5, "b": 0.5}'
    with pytest.raises(ContractError):
        blend.best_recipe(spark.createDataFrame(pdf), ["a", "b"], [0.2], 1.0, required=("a", "b"))
    rows = spark.createDataFrame([("z", 0.5, 0.9), ("b", 0.7, 0.1), ("a", 0.7, 0.1), ("c", 0.7, 0.05)], "recipe string, macro_f1 double, recall double")
    assert blend.select_recipe(rows).first().recipe == "a"


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from matchrank.operators.lineage import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))
