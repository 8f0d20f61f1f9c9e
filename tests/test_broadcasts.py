"""What the retrieval queries broadcast doesn't grow with the tables: counted over every execution of a run."""

import os

import pytest

import __spark_entry__ as entry
from matchrank.operators import lineage, retrieval
from matchrank.plans import retrieval_queries as rq

#: More than the lists of range partitions, totals and names; fewer than the terms, items and features of the tables.
FEW = 64


def broadcasts(spark, after):
    """Rows of each broadcast of the executions that follow ``after``, with the execution's number."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda seq: [seq.apply(k) for k in range(seq.size())]
    found = []
    for run in listed(store.executionsList()):
        if run.executionId() <= after:
            continue
        values = store.executionMetrics(run.executionId())
        for node in listed(store.planGraph(run.executionId()).allNodes()):
            for m in listed(node.metrics()) if node.name() == "BroadcastExchange" else []:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    found.append((int(values.apply(m.accumulatorId()).replace(",", "")), run.executionId()))
    return found


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="no test data")
@pytest.mark.parametrize(
    "query",
    [
        "hybrid_slate",
        "latent_topk",
        "lexical_slate",
        "near_duplicate_filter",
        "recall_variants",
        "reranker_negatives",
        "slate_rate_decision",
        "tfidf_band_negatives",
        "tfidf_band_negatives_300",
        "two_space_similarity",
        "vector_features",
        "rank_band_negatives",
        "hybrid_slate_dense",
    ],
)
def test_no_table_is_broadcast_by_its_estimate(spark, monkeypatch, query):
    sorted_beyond = lambda df: lineage.small_or_sorted(df, 3)
    for module in (retrieval, rq):  # written tables count as large here
        monkeypatch.setattr(module, "small_or_sorted", sorted_beyond, raising=False)
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    last = max((runs.apply(k).executionId() for k in range(runs.size())), default=-1)
    assert entry.queries()[query](spark, entry.SMOKE_DIR).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert [x for x in broadcasts(spark, last) if x[0] > FEW] == []
