"""Tables that come out of ``explode`` are never broadcast by their estimate; repeated texts are scored once."""

import pytest
from pyspark.sql import functions as F

from matchrank.operators import draws, features, latent, lineage, metrics, negatives, retrieval

SPLIT = lambda c: F.split(c, " ")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.range(300).select(F.format_string("i%03d", "id").alias("item_id"), F.concat_ws(" ", F.format_string("w%d", F.col("id") % 40), F.format_string("v%d", F.col("id") % 7), F.lit("all")).alias("text"))


def test_counts_are_not_broadcast(spark, corpus, monkeypatch):
    space = retrieval.fit_tfidf([(corpus, "item_id")], SPLIT)
    counts = lineage.cut(retrieval.term_counts(corpus, "item_id", SPLIT(F.col("text"))))
    few = plan(space.weights(counts, "item_id"))
    assert "BuildRight" in few and "BuildLeft" not in few  # the vocabulary, which was counted
    monkeypatch.setattr(retrieval, "small_or_sorted", lambda df: lineage.small_or_sorted(df, 3))
    many = retrieval.Tfidf(space.vocab, SPLIT)
    assert "Broadcast" not in plan(many.weights(counts, "item_id"))
    want = {(r.item_id, r.fid): r.w for r in space.weights(counts, "item_id").collect()}
    assert {(r.item_id, r.fid): r.w for r in many.weights(counts, "item_id").collect()} == pytest.approx(want)


def test_recall_and_pairs_are_joined_by_sorts(spark, corpus):
    vectors = lineage.cut(retrieval.fit_tfidf([(corpus, "item_id")], SPLIT).transform(corpus, "item_id"))
    pairs = spark.createDataFrame([("i000", "i040")], "query_id string, item_id string")
    assert "Broadcast" not in plan(retrieval.pair_similarity(pairs, vectors.withColumnRenamed("item_id", "query_id"), vectors))
    dense = corpus.select("item_id", F.array(F.lit(1.0)).alias("vector"))
    assert "Broadcast" not in plan(retrieval.pair_cosine(pairs, dense.withColumnRenamed("item_id", "query_id"), dense))
    ranked = corpus.select(F.lit("t").alias("term_id"), "item_id", F.lit(1).alias("rank"))
    assert "Broadcast" not in plan(metrics.recall_at(ranked, ranked.drop("rank"), "rank", [1]))
    assert "Broadcast" not in plan(metrics.recall_variants(ranked, ranked, ranked.drop("rank"), 1))


@pytest.mark.parametrize("k", [3, 20, 400])
def test_repeated_texts_give_the_same_rows(spark, corpus, k):
    queries = spark.createDataFrame([("a", "w1 v1"), ("b", "all w2 w3"), ("c", "none")], "query_id string, text string")
    items = corpus.unionByName(spark.createDataFrame([("n1", None), ("n2", None), ("n3", "")], "item_id string, text string"))
    rows = lambda repeats: {tuple(r) for r in retrieval.tfidf_top_k(queries, items, SPLIT, k, repeats=repeats).select("query_id", "item_id", F.round("score", 9), "rank").collect()}
    assert rows(True) == rows(False) and len(rows(True)) >= min(k, 300)
    texts, members = retrieval.distinct_texts(items)
    assert texts.agg(F.sum("n")).first()[0] == members.count() == 303 and texts.count() == 282


def test_vector_features_score_equal_items_once(spark):
    """Items that differ in their id alone give one row to be scored, and all their pairs a result."""
    fields = "item_id string, title string, category string, brand string, gender string, age_group string, attributes string"
    items = spark.createDataFrame([(f"i{k}", f"red shoe {k % 2}", "a/b", "x", "", "", "size 4") for k in range(10)], fields)
    terms = spark.createDataFrame([("t", "red shoe"), ("u", "shoe 1")], "term_id string, query string")
    pairs = terms.crossJoin(items).select(F.concat_ws("#", "term_id", "item_id").alias("id"), "term_id", "item_id")
    space = retrieval.fit_tfidf([(items.select("item_id", F.col("title").alias("text")), "item_id")], SPLIT)
    out = features.vector_features(pairs, terms, items, space, space)
    rows = out.collect()
    assert len(rows) == 20 and len({r.id for r in rows}) == 20
    assert len({(r.term_id, int(r.item_id[1:]) % 2, r.vector_score) for r in rows}) == 4


def test_counts_of_documents_are_a_row_each(spark):
    """As many rows as documents, null and empty ones too, and no shuffle; repeated ids still merge."""
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b"), (4, "")], "item_id int, text string")
    rows = retrieval.counted(docs, "item_id", SPLIT(F.col("text")))
    assert "Exchange" not in plan(rows) and rows.count() == 4
    long = {(r.item_id, r.fid): r.tf for r in retrieval.term_counts(docs, "item_id", SPLIT(F.col("text"))).collect()}
    assert {(r.item_id, f): n for r in rows.collect() for f, n in zip(r.f, r.tf, strict=True)} == long
    queries = spark.createDataFrame([(1, "a b")], "query_id int, text string")
    q, i = retrieval.fit_sides(queries, docs.unionByName(docs), SPLIT)
    assert i.select("item_id").distinct().count() == 2 and i.count() == 3


def test_equal_items_are_compared_with_positives_once(spark):
    """Items that differ in their id alone are one kind, null brands too; each of them is found."""
    rows = [(k, f"red shoe {k % 3}", None if k % 2 else "x", ["red", "shoe", str(k % 3)]) for k in range(600)]
    items = spark.createDataFrame(rows, "item_id long, title string, brand string, tokens array<string>")
    near = negatives.NearCopies(spark.createDataFrame([("t", 0)], "term_id string, item_id long"), items)
    assert near.kinds.count() == 6 and near.members.count() == 600
    got = {r.item_id for r in near(items.select(F.lit("t").alias("term_id"), "item_id")).collect()}
    assert got == {k for k in range(600) if k % 3 == 0}


def test_draws_share_a_placed_catalog(spark, corpus):
    terms = spark.createDataFrame([("a", 5), ("b", 40)], "term_id string, n long")
    taken = corpus.select(F.lit("a").alias("term_id"), "item_id").where("item_id < 'i200'")
    rows = lambda items: {tuple(r) for r in draws.draw(terms, taken, items, "x").collect()}
    assert rows(draws.placed(corpus)) == rows(corpus) and len(rows(corpus)) == 45


def test_repeated_texts_weigh_as_often_in_the_latent_space(spark, corpus, monkeypatch):
    """Each text once with its number gives the factor of all items, in blocks of rows as in one."""
    queries = spark.createDataFrame([("a", "w1 v1")], "query_id string, text string")
    texts, members = retrieval.distinct_texts(corpus.where("item_id < 'i290'"))
    monkeypatch.setattr(latent, "_ROWS", 7)
    found = []
    for items in (texts, corpus.where("item_id < 'i290'")):
        _, i = retrieval.fit_sides(queries, items, SPLIT, every=True)
        rows = retrieval.gathered_vectors({"x": i}, "item_id").join(items.drop("text"), "item_id")
        found.append(latent.fit_rows(lineage.cut(rows), rank=3, passes=8))
    assert found[0].features.tolist() == found[1].features.tolist() and len(found[0].features) == 48
    assert abs(found[0].components.T @ found[1].components).round(6).tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    pairs = members.select(F.lit("a").alias("query_id"), "item_id")
    score = lambda p: p.withColumn("similarity", F.length("item_id"))
    met = []
    assert retrieval.by_members(pairs, members, lambda p: met.append(p.count()) or score(p)).count() == 290 and met == [280]
