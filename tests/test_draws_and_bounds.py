"""Draws by keyed permutations, and sparse top-k by bounds of item blocks."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from matchrank.operators import draws, negatives, retrieval
from matchrank.sources.contracts import ContractError


@pytest.mark.parametrize("n", [1, 2, 7, 200, 1000])
def test_orders_are_permutations_that_differ(spark, n):
    a, b = draws.grid(n)
    assert a * b - n < max(a, b)
    steps = spark.range(a * b).select(F.col("id").alias("step"), F.explode(F.array(F.lit("s"), F.lit("t"))).alias("term"))
    rows = steps.select("term", "step", draws.permuted(F.col("step"), draws.round_keys("seed", F.col("term")), n).alias("p")).collect()
    orders = {t: [r.p for r in sorted(rows, key=lambda r: r.step) if r.term == t] for t in "st"}
    assert all(sorted(o) == list(range(a * b)) for o in orders.values())
    assert n < 10 or orders["s"] != orders["t"]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.range(400).select(F.format_string("i%03d", "id").alias("item_id")).cache()


def test_terms_draw_independently_and_uniformly(spark, catalog):
    terms = spark.range(120).select(F.format_string("t%d", "id").alias("term_id"), F.lit(20).alias("n"))
    none = spark.createDataFrame([], "term_id string, item_id string")
    got = {}
    for r in draws.draw(terms, none, catalog, "x").collect():
        got.setdefault(r.term_id, {})[r.pick] = r.item_id
    assert all(sorted(p) == list(range(1, 21)) and len(set(p.values())) == 20 for p in got.values())
    sets = [set(p.values()) for p in got.values()]
    shared = [len(a & b) for a, b in combinations(sets, 2)]
    # 20 of 400 for both: one shared item is expected, whatever the pair
    assert abs(sum(shared) / len(shared) - 1) < 0.1 and max(shared) < 8
    counts = Counter(i for s in sets for i in s)
    assert len(counts) > 390 and max(counts.values()) < 20


def test_short_catalogs_raise_or_give_what_there_is(spark, catalog):
    terms = spark.createDataFrame([("a", 5), ("b", 400), ("c", 390)], "term_id string, n int")
    taken = catalog.where("item_id < 'i020'").select(F.lit("c").alias("term_id"), "item_id")
    with pytest.raises(ContractError, match="1 terms find too few"):
        draws.draw(terms, taken, catalog, "x")
    got = Counter(r.term_id for r in draws.draw(terms, taken, catalog, "x", short="fewer").collect())
    assert got == {"a": 5, "b": 400, "c": 380}
    assert draws.draw(terms, taken, catalog.where("false"), "x", short="fewer").count() == 0


def test_no_uniform_row_is_a_near_copy_of_a_positive(spark):
    """Half of the catalog shares title and brand with the positives of every term."""
    items = spark.range(80).select(F.format_string("i%02d", "id").alias("item_id"), F.when(F.col("id") < 40, "red shoe").otherwise(F.format_string("item %d", "id")).alias("title"), F.lit("b").alias("brand")).withColumn("tokens", F.split("title", " "))
    positives = spark.range(6).select(F.format_string("t%d", "id").alias("term_id"), F.lit("i00").alias("item_id"))
    pool = positives.select("term_id").crossJoin(items.select("item_id")).withColumn("rank", F.lit(1)).withColumn("score", F.lit(0.5))
    rows = negatives.rank_band_negatives(pool, pool, positives, items, 50, 60, 4, uniform_rows=10).collect()
    assert Counter(r.negative_source for r in rows) == {"uniform": 60, "uniform_backfill_lexical": 24, "uniform_backfill_embedding": 24}
    assert len({(r.term_id, r.item_id) for r in rows}) == len(rows) and all(r.item_id >= "i40" for r in rows)


@pytest.mark.parametrize("k", [1, 5, 200])
def test_sparse_top_k_by_bounds_equals_all_products(spark, k):
    rng = random.Random(k)
    feature = lambda: rng.choice([rng.randrange(4), rng.randrange(200), rng.randrange(200)])
    vector = lambda n: {feature(): rng.random() ** 3 for _ in range(rng.randrange(1, n))}
    q, x = {f"q{i}": vector(6) for i in range(40)}, {f"i{i:03d}": vector(12) for i in range(300)}
    q["none"], x["copy"] = {999: 1.0}, dict(x["i000"])
    long = lambda rows, key: spark.createDataFrame([(i, f, w) for i, v in rows.items() for f, w in v.items()], f"{key} string, fid long, w double")
    report = {}
    got = {}
    for r in retrieval.sparse_top_k(long(q, "query_id"), long(x, "item_id"), k, q_block=8, i_block=12, report=report).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.item_id, r.score)
    for i, v in q.items():
        scores = sorted(((-round(sum(w * y.get(f, 0) for f, w in v.items()), 9), j) for j, y in x.items() if v.keys() & y.keys()))
        want = [(j, -s) for s, j in scores if s < 0][:k]
        mine = [got.get(i, {})[n + 1] for n in range(len(got.get(i, {})))]
        assert [m[0] for m in mine] == [w[0] for w in want] and [m[1] for m in mine] == pytest.approx([w[1] for w in want])
    assert report["all_meetings"] == report["queries"] * report["item_blocks"] and report["meetings"] <= report["all_meetings"] and report["copies"] <= report["all_copies"]
    if k == 1:  # most blocks lack the query's heavy features
        assert report["meetings"] < 0.5 * report["all_meetings"]
