"""Tiered search against sums over all documents in plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchrank.llm import lexical


def _terms(text):
    return re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items, k):
    """docs: (id, text) in order of id, nulls last; items: {id: text}."""
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for item, text in items.items():
        rows = []
        for place, (i, b) in enumerate(bags):
            m = 75 + 25 * sum(b.values()) * n_docs // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m)) for w, c in Counter(_terms(text)).items() if w in b)
            if s > 0:
                rows.append((-s, place, i))
        out[item] = [(i, -s) for s, _, i in sorted(rows)[:k]]
    return out


def _answers(got):
    out = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    common, rare = [f"w{k}" for k in range(30)], [f"Rare{k}é" for k in range(300)]
    text = lambda n, m: " ".join(rng.choices(common, k=n) + rng.choices(rare, k=m))
    passage = "rare1é rare2é Rare3é rare4é w1 w2"
    docs = [(k, text(rng.randrange(1, 60), rng.randrange(0, 5)) + (f" {passage} {passage}" if k % 9 == 0 else "")) for k in range(600)]
    docs += [(k, docs[k][1]) for k in (5, 6)] + [(None, passage), (None, None), (700, ""), (701, "#!")]
    items = {0: passage, 1: text(8, 3), 2: "w1 w1 w1 w2", 3: "nothing known", 4: None, 5: "rare7é", 6: text(30, 30)}
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(list(items.items()), "item_id long, text string")


@pytest.mark.parametrize("cuts", [(), (0.25, 0.0625), (0.5, 0.3, 0.1)])
@pytest.mark.parametrize("restricted", [False, True])
def test_search_equals_brute_force(spark, world, cuts, restricted, monkeypatch):
    docs, items, d, i = world
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 37)
    asked = i.select(F.explode(lexical.terms(F.col("text"))).alias("term")) if restricted else None
    report = []
    got = _answers(lexical.search(lexical.build(d.withColumns({"n": F.lit("x"), "block": F.lit(1)}), asked=asked, cuts=cuts), i, 5, report=report))
    want = _brute(sorted(docs, key=lambda r: (r[0] is None, r[0])), items, 5)
    assert got == {k: v for k, v in want.items() if v}
    assert [t for t, _, _ in report] == list(range(len(report))) and all(a - p == b for (_, a, p), (_, b, _) in zip(report, report[1:]))
    if cuts == (0.5, 0.3, 0.1):  # the copies of the passage prove its item before the last tier
        assert sum(p for t, _, p in report if t < len(cuts)) > 0


def test_turns_and_asked_by_a_join(spark, world, monkeypatch):
    docs, items, d, i = world
    monkeypatch.setattr(lexical, "PAIRS", 12)
    monkeypatch.setattr(lexical, "ASKED", 3)
    monkeypatch.setattr(lexical, "SENT", 0)
    got = _answers(lexical.search(lexical.build(d, asked=i.select(F.explode(lexical.terms(F.col("text"))).alias("term"))), i, 3))
    assert got == {k: v for k, v in _brute(sorted(docs, key=lambda r: (r[0] is None, r[0])), items, 3).items() if v}


def test_empty_tables_and_string_ids(spark, world):
    docs, items, d, i = world
    assert lexical.search(lexical.build(d.where("false")), i).count() == 0
    assert lexical.search(lexical.build(d), i.where("false")).count() == 0
    named = d.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text")
    got = _answers(lexical.search(lexical.build(named), i.withColumn("item_id", F.col("item_id").cast("string")), 4))
    want = _brute(sorted(((None if k is None else f"d{k}", t) for k, t in docs), key=lambda r: (r[0] is None, r[0])), items, 4)
    assert got == {str(k): v for k, v in want.items() if v}


def test_repeated_items_are_one(spark, world):
    docs, items, d, _ = world
    i = spark.createDataFrame([(1, "w1 rare1é"), (1, "w1"), (None, "rare2é")], "item_id long, text string")
    got = _answers(lexical.search(lexical.build(d), i, 4))
    assert got == _brute(sorted(docs, key=lambda r: (r[0] is None, r[0])), {1: "w1 rare1é w1", None: "rare2é"}, 4)
