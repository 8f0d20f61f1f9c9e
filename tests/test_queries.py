"""Every registered query with a SQL twin against DuckDB, on the smallest tables."""

import difflib
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from matchrank.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _rows(frame):
    return sorted(map(repr, frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    plain = lambda f: f.astype({c: "float64" for c in f.columns if f[c].dtype.kind in "iuf"} | {c: "int64" for c in f.columns if f[c].dtype.kind == "b"})
    assert _rows(plain(ours)) == _rows(plain(theirs))
    spark.catalog.clearCache()


def test_entry_and_oracles_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev if x == y else min(row[j], row[j - 1]) + 1
    total = len(a) + len(b)
    return 100.0 * (total - row[-1]) / total if total else 100.0


def partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0 if b else 100.0
    return max(indel(a, b[max(0, k) : k + len(a)]) for k in range(1 - len(a), len(b)))


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(indel(one, two), indel(both, one) if both else 0, indel(both, two) if both else 0)


def test_fuzzy_query_equals_plain_python(spark):
    """The three ratios of the registered query against textbook definitions."""

    from matchrank.functions.text import normalize_text
    from matchrank.plans.adapters import candidate_pairs, items, terms

    t = dict(terms(spark, SF).select("term_id", normalize_text(F.col("query"))).collect())
    i = dict(items(spark, SF).select("item_id", normalize_text(F.col("title"))).collect())
    pairs = {r.id: (t[r.term_id], i[r.item_id]) for r in candidate_pairs(spark, SF).collect()}
    got = catalog.QUERIES["fuzzy_ratios"](spark, SF).collect()
    assert len(got) == len(pairs)
    known = {}
    for r in got:
        p = pairs[r.id]
        if p not in known:
            known[p] = (indel(*p), partial(*p), token_set(*p), 100 * difflib.SequenceMatcher(None, *p).ratio())
        assert (r.ratio, r.partial_ratio, r.token_set_ratio, r.sequence_ratio) == pytest.approx(known[p])


def test_entity_cosine_equals_plain_python(spark):
    """Each pair's cosine, directly and through the artifact."""
    import zlib

    import numpy as np

    from matchrank.plans.adapters import items, terms
    from matchrank.sources import tables

    def vector(text):
        v = np.zeros(64)
        for k in range(len(text) - 2):
            c = zlib.crc32(text[k : k + 3].encode())
            v[c % 64] += 1 if c >> 31 else -1
        n = np.linalg.norm(v)
        return v / n if n else v

    t = {r.term_id: vector(r.query) for r in terms(spark, SF).collect()}
    i = {r.entity_id: vector(r.text) for r in tables.entity_texts(items(spark, SF), "item_id").collect()}
    rows = catalog.QUERIES["entity_cosine"](spark, SF).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.cosine == r.from_artifact == pytest.approx(float(t[r.term_id] @ i[r.item_id]))


def test_models_separate_their_labels(spark):
    """Scores of held-out folds carry what was learned; importances are over all features, largest first."""
    rows = catalog.QUERIES["oof_with_prior"](spark, SF).toPandas()
    assert rows.id.is_unique and set(rows.fold) == {0, 1} and rows.prob.between(0, 1).all()
    assert rows[rows.label == 1].prob.mean() > rows[rows.label == 0].prob.mean() + 0.2
    found = catalog.QUERIES["feature_importance"](spark, SF).collect()
    assert {r.feature for r in found} == {"l_quantity", "l_discount", "ship_day", "part", "supplier"}
    assert sum(r.importance for r in found) == pytest.approx(1) and [r.importance for r in found] == sorted((r.importance for r in found), reverse=True)


def test_score_with_ratios_equals_plain_python(spark):
    """The three ratio terms and their half of the weak-match penalty, from textbook ratios."""
    from matchrank.operators import features
    from matchrank.plans.adapters import candidate_pairs, items, terms

    joined = features.join_pairs(candidate_pairs(spark, SF), terms(spark, SF), items(spark, SF))
    base = features.pair_features(joined, ratios=False).withColumn("plain", features.linear_score(False)).select("id", "query", "title", "category", "brand", "full_cov", "weak_match", "plain").collect()
    got = {r.id: r.score for r in catalog.QUERIES["lexical_score_with_ratios"](spark, SF).collect()}
    assert len(got) == len(base)
    known = {}
    for r in base:
        key = (r.query, r.title, r.category, r.brand)
        if key not in known:
            brand = max(indel(r.query, r.brand), partial(r.query, r.brand) if r.brand else 0) / 100
            known[key] = token_set(r.query, r.title) / 100, token_set(r.query, r.category) / 100, brand
        title, category, brand = known[key]
        weak = float(r.full_cov < 0.34 and max(title, category, brand) < 0.55)
        assert got[r.id] == pytest.approx(r.plain + 0.75 * title + 0.45 * category + 0.55 * brand + 0.9 * (r.weak_match - weak))


def test_tree_scores_rank_within_reach(spark):
    """Every row is scored once, by trees of the other folds."""
    rows = catalog.QUERIES["gbt_scores"](spark, SF).toPandas()
    assert rows.id.is_unique and set(rows.fold) == {0, 1, 2} and rows.prob.between(0, 1).all() and rows.prob.nunique() > 20


@pytest.mark.parametrize("name", ["pair_head_scores", "pair_head_perceptron"])
def test_pair_heads_score_every_pair(spark, name):
    rows = catalog.QUERIES[name](spark, SF).toPandas()
    assert rows.prob.between(0, 1).all() and set(rows.label) == {0, 1}
    assert rows[rows.label == 1].prob.mean() > rows[rows.label == 0].prob.mean()


def test_file_audit_sees_every_file(spark):
    rows = catalog.QUERIES["file_audit"](spark, SF).collect()
    assert {r.table_name for r in rows} == {os.path.basename(f)[:-8] for f in glob.glob(f"{SF}/*.parquet")}
    assert all(r.megabytes > 0 and r.rows > 0 for r in rows)
