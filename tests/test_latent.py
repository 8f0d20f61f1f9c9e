"""The learned encoder against a dense SVD, and the dense pool of the registered slate."""

import numpy as np
import pytest

from matchrank.operators import latent
from matchrank.plans import retrieval_queries as rq
from matchrank.sources.contracts import ContractError

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 40)) + 0.01 * rng.normal(size=(60, 40))
    x[np.abs(x) < 0.5] = 0
    rows = [(int(i), int(f) * 1_000_003, float(x[i, f])) for i, f in zip(*np.nonzero(x), strict=True)]
    return x, spark.createDataFrame(rows, "item_id long, fid long, w double")


def test_factor_spans_the_leading_singular_vectors(spark, space):
    x, rows = space
    fitted = latent.fit(rows, "item_id", rank=5, passes=12)
    right = np.linalg.svd(x, full_matrices=False)[2][:5].T
    assert np.allclose(fitted.components.T @ fitted.components, np.eye(5)) and fitted.features.tolist() == [f * 1_000_003 for f in range(40)]
    assert np.linalg.norm(right.T @ fitted.components, axis=0).min() > 0.999
    y = x @ fitted.components
    got = {r.item_id: r.vector for r in fitted.encode(rows, "item_id").collect()}
    assert all(np.allclose(got[i], y[i] / np.linalg.norm(y[i])) for i in range(60))


def test_bounds_and_unknown_features(spark, space, monkeypatch):
    _, rows = space
    fitted = latent.fit(rows, "item_id", rank=64)
    assert fitted.components.shape == (40, 40)
    other = fitted.encode(spark.createDataFrame([(1, 7, 1.0)], "item_id long, fid long, w double"), "item_id").first()
    assert other.vector == [0.0] * 40
    assert latent.fit(rows.where("false"), "item_id").components.shape[0] == 0
    monkeypatch.setattr(latent, "MOST_CELLS", 100)
    with pytest.raises(ContractError, match="cells"):
        latent.fit(rows, "item_id", rank=5)


def test_registered_dense_pool(spark):
    """Every candidate has its cosine, in no candidate a stand-in, and the pool finds most of what the sparse one does."""
    q, i = rq._latent(spark, SF)
    vectors = {r.query_id: np.array(r.vector) for r in q.collect()}, {r.item_id: np.array(r.vector) for r in i.collect()}
    rows = rq.hybrid_slate_dense(spark, SF).collect()
    for r in rows[::17]:
        assert r.semantic_cosine == pytest.approx(float(vectors[0][r.term_id] @ vectors[1][r.item_id]), abs=1e-6)
    assert any("embedding" in r.candidate_sources for r in rows) and {r.label for r in rows} == {0, 1}
    recall = {r.k: r.recall for r in rq.latent_recall(spark, SF).collect()}
    assert recall[100] >= recall[50] >= recall[10] and recall[100] > 0.8
