"""The mining queries at their whole size against plain Python: 620 items, all of them retrieved."""

import hashlib
import math
import random
from collections import Counter

import pytest

from matchrank.plans import retrieval_queries as rq


def _grams(t):
    w = [x for x in t.split() if len(x) > 1]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def _chars(t):
    out = []
    for w in t.split():
        p = f" {w} "
        for n in (3, 4):
            out += [p[k : k + n] for k in range(len(p) - n + 1)] if len(p) > n else [p] * (n == 3 or len(p) == n)
    return out


def _ranked(terms, items, features):
    bags = {("t", k): Counter(features(v)) for k, v in terms.items()} | {("i", k): Counter(features(v)) for k, v in items.items()}
    df = Counter(f for b in bags.values() for f in b)
    w = {k: {f: (1 + math.log(n)) * (math.log((1 + len(bags)) / (1 + df[f])) + 1) for f, n in b.items() if df[f] > 1} for k, b in bags.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in w.items()}
    out = {}
    for t in terms:
        a = w["t", t]
        score = {i: round(sum(x * w["i", i].get(f, 0) for f, x in a.items()) / (norm["t", t] * norm["i", i]), 9) for i in items if a.keys() & w["i", i].keys()}
        out[t] = {i: k + 1 for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i)))}
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    some = [word(5) for _ in range(60)]
    items = {i: " ".join(["common", *rng.sample(some, 6), f"own{i}"]) for i in range(1, 621)}
    terms = {t: " ".join(["common", *rng.sample(some, 4)]) for t in (1, 2, 3)}
    positives = {(t, rng.randrange(1, 621)) for t in terms for _ in range(4)}
    frames = {
        "items": spark.createDataFrame([(i, t, "", "", "") for i, t in items.items()], "item_id long, title string, brand string, category string, attributes string"),
        "terms": spark.createDataFrame(list(terms.items()), "term_id long, query string"),
        "positives": spark.createDataFrame(sorted(positives), "term_id long, item_id long"),
    }
    patch = pytest.MonkeyPatch()
    for name, frame in frames.items():
        patch.setattr(rq, name, lambda spark, sf, frame=frame: frame)
    yield terms, items, positives, _ranked(terms, items, _grams), _ranked(terms, items, _chars)
    patch.undo()


def _first(pool, n, seed, t):
    sha = lambda i: hashlib.sha256(chr(31).join((seed, str(t), str(i))).encode()).hexdigest()
    return set(sorted(pool, key=lambda i: (sha(i), i))[:n])


@pytest.mark.parametrize(("query", "low", "high", "each", "n_uniform"), [("contrastive_negatives", 101, 500, 10, 0), ("reranker_negatives", 21, 200, 15, 20)])
def test_rank_bands_reach_their_last_rank(spark, world, query, low, high, each, n_uniform):
    terms, _, positives, lexical, chars = world
    rows = rq.QUERIES[query](spark, "").collect()
    for t in terms:
        of = lambda source, t=t: {r.item_id: r.source_rank for r in rows if r.term_id == t and r.negative_source == source}
        out = set(of("uniform"))
        assert len(out) == n_uniform and not any((t, i) in positives for i in out)
        for family, rank in (("lexical", lexical[t]), ("embedding", chars[t])):
            pool = [i for i, r in rank.items() if low <= r <= high and (t, i) not in positives and i not in out]
            want = _first(pool, each, f"mine-{family}", t)
            assert of(family) == {i: rank[i] for i in want} and len(want) == each
            out |= want
    assert len(rows) == 3 * (2 * each + n_uniform)


def test_tfidf_bands_use_300_rows(spark, world):
    terms, _, positives, lexical, _ = world
    rows = rq.QUERIES["tfidf_band_negatives_300"](spark, "").collect()
    for t in terms:
        of = lambda band, t=t: {r.item_id for r in rows if r.term_id == t and r.negative_band == band}
        free = [i for i, r in lexical[t].items() if r <= 300 and (t, i) not in positives]
        assert of("hard") == set(free[:25]) and of("mid") == _first(free[25:], 15, "tfidf", t)
        assert len(of("easy")) == 10 and all(lexical[t].get(i, 999) > 300 and (t, i) not in positives for i in of("easy"))
