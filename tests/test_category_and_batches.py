"""The one-vs-rest category prior and the training batches against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from matchrank.operators import category, negatives


def _grams(text):
    out = []
    for word in text.split():
        p = f" {word} "
        for n in range(2, 6):
            if len(p) <= n:
                out += [p] if n == len(p) or n == 2 else []
            else:
                out += [p[k : k + n] for k in range(len(p) - n + 1)]
    return out


def _prior(examples, queries, epochs, rate, penalty, k):
    """TF-IDF, then one model per class, a row and a feature at a time."""
    sizes = Counter(c for _, c in examples)
    rows = sorted({(q, c) for q, c in examples if sizes[c] >= 2}, key=lambda r: "\x1f".join(r))
    df = Counter(g for q, _ in rows for g in set(_grams(q)))
    idf = {g: math.log((1 + len(rows)) / (1 + d)) + 1 for g, d in df.items() if d >= 2}

    def vector(text):
        v = {g: (1 + math.log(n)) * idf[g] for g, n in Counter(_grams(text)).items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    data = [(vector(q), c) for q, c in rows if vector(q)]
    classes = sorted({c for _, c in rows})
    scores = defaultdict(dict)
    for c in classes:
        own = len(rows) / (len(classes) * sum(d == c for _, d in rows))
        w, seen, b, b_seen = defaultdict(float), defaultdict(lambda: 1e-8), 0.0, 1e-8
        for _ in range(epochs):
            for at in range(0, len(data), 32):
                part = data[at : at + 32]
                slopes = [(1 / (1 + math.exp(-(b + sum(w[g] * x for g, x in v.items())))) - (d == c)) * (own if d == c else 1) / len(part) for v, d in part]
                g = {f: penalty * w[f] for v, _ in part for f in v}
                for s, (v, _) in zip(slopes, part, strict=True):
                    for f, x in v.items():
                        g[f] += s * x
                for f, x in g.items():
                    seen[f] += x * x
                    w[f] -= rate * x / math.sqrt(seen[f])
                b_seen += sum(slopes) ** 2
                b -= rate * sum(slopes) / math.sqrt(b_seen)
        for t, q in queries:
            scores[t][c] = 1 / (1 + math.exp(-(b + sum(w[g] * x for g, x in vector(q).items()))))
    return {t: sorted(((p / sum(s.values()), c) for c, p in s.items()), key=lambda x: (-round(x[0], 12), x[1]))[:k] for t, s in scores.items()}


@pytest.fixture(scope="module")
def small():
    rng = random.Random(6)
    words = {c: [f"{c}{rng.choice('aeiou')}{rng.choice('lmnr')}{k}" for k in range(6)] for c in ("red", "shoe", "bag", "cup", "lamp")}
    examples = [(" ".join(rng.sample(words[c], 2)), c) for c in words for _ in range(14)] + [("alone", "single")]
    return examples, [(k, " ".join(rng.sample(words[c], 2))) for k, c in enumerate(list(words) * 3)] + [(99, "zzzz")]


@pytest.mark.parametrize("block", [64, 2])
def test_prior_equals_plain_python_in_blocks(spark, small, monkeypatch, block):
    examples, queries = small
    monkeypatch.setattr(category, "CLASS_BLOCK", block)
    monkeypatch.setattr(category, "TERM_BLOCK", 7)
    ex = spark.createDataFrame(examples, "query_norm string, cat_l2 string")
    asked = spark.createDataFrame(queries, "term_id long, query_norm string")
    got = defaultdict(list)
    for r in category.logistic_prior(ex, asked, "cat_l2", 3, epochs=4).orderBy("term_id", "rank").collect():
        got[r.term_id].append((r.prob, r.label))
    for t, rows in _prior(examples, queries, 4, 0.5, 2e-5, 3).items():
        assert [c for _, c in got[t]] == [c for _, c in rows] and [p for p, _ in got[t]] == pytest.approx([p for p, _ in rows], abs=1e-9)


def test_shards_are_averaged_and_still_tell(spark, small, monkeypatch):
    examples, queries = small
    monkeypatch.setattr(category, "SHARD", 30)
    ex, asked = spark.createDataFrame(examples, "query_norm string, cat_l2 string"), spark.createDataFrame(queries[:-1], "term_id long, query_norm string")
    top = {r.term_id: r.label for r in category.logistic_prior(ex, asked, "cat_l2", 1).collect()}
    assert sum(queries[t][1].startswith(c) for t, c in top.items()) >= 14
    assert {r.label for r in category.logistic_prior(ex.where("cat_l2 = 'red'"), asked, "cat_l2").collect()} == {"red"}
    assert {r.label for r in category.logistic_prior(ex.where("false"), asked, "cat_l2").collect()} == {"unknown"}


def _batches(spark, n, pool_of, catalog):
    rows = spark.createDataFrame([(f"b{b}", 4 * b + k, f"t{b}-{k}", f"p{b}-{k}") for b in range(n) for k in range(4)], "batch string, row_index long, term_id string, item_id string")
    pool = spark.createDataFrame([x for b in range(n) for k in range(4) for x in pool_of(b, k)], "term_id string, family string, item_ids array<string>")
    return negatives.assemble_batches(rows, pool, spark.createDataFrame([(i,) for i in catalog], "item_id string"))


def test_recipe_holds_for_many_batches(spark):
    """Four rows give 4 targets, 2 and 2 semi-hard items and 12 uniform ones, in each of 30 batches."""
    names = [f"{f}{b}-{k}" for f in "ple" for b in range(30) for k in range(4)] + [f"u{k}" for k in range(100)]
    out = _batches(spark, 30, lambda b, k: [(f"t{b}-{k}", "lexical", [f"l{b}-{k}"]), (f"t{b}-{k}", "embedding", [f"e{b}-{k}"])], names)
    first, again = (sorted(map(tuple, out.collect())) for _ in range(2))
    assert first == again and len(first) == 600
    for b in range(30):
        own = [r for r in first if r[0] == f"b{b}"]
        assert Counter(r[4] for r in own) == {"positive": 4, "lexical": 2, "embedding": 2, "uniform": 12}
        assert len({r[3] for r in own}) == 20 and [r[1] for r in own] == list(range(20))
    assert len({r[3] for r in first if r[4] == "uniform"}) > 150


def test_families_fall_back_in_order(spark):
    """No lexical list: the other family; all taken: the uniform family; none: the catalog; too few items: an error."""
    pools = {0: [("embedding", ["e"])], 1: [("embedding", ["e"]), ("lexical", ["e", "l"])], 2: [("lexical", ["e", "p0-0"]), ("uniform", ["u"])], 3: []}
    catalog = [f"c{k:02d}" for k in range(40)]
    rows = sorted(map(tuple, _batches(spark, 1, lambda b, k: [(f"t{b}-{k}", f, v) for f, v in pools[k]], catalog).collect()), key=lambda r: r[1])
    assert [(r[2], r[4]) for r in rows[4:8]] == [(0, "embedding"), (1, "lexical"), (2, "uniform"), (3, "uniform_backfill")]
    assert [r[3] for r in rows[4:7]] == ["e", "l", "u"] and len({r[3] for r in rows}) == 20
    with pytest.raises(Exception, match="the catalog is too small"):
        _batches(spark, 1, lambda b, k: [], catalog[:9]).collect()


@pytest.mark.parametrize("least", [0.5, 0.9])
def test_near_copies_equal_all_comparisons(spark, least):
    rng = random.Random(9)
    tokens = [sorted(rng.sample([f"w{k}" for k in range(14)], rng.randrange(0, 12))) for _ in range(120)]
    items = [(i, f"title {i % 40}", f"b{i % 3}", t) for i, t in enumerate(tokens)]
    positives = {(t, rng.randrange(120)) for t in range(6) for _ in range(9)}
    pairs = [(t, i) for t in range(6) for i in range(120)]
    frame = spark.createDataFrame(items, "item_id long, title string, brand string, tokens array<string>")
    near = negatives.NearCopies(spark.createDataFrame(sorted(positives), "term_id long, item_id long"), frame, least)
    got = {(r.term_id, r.item_id) for r in near(spark.createDataFrame(pairs, "term_id long, item_id long")).collect()}

    def alike(a, b):
        a, b = set(tokens[a]), set(tokens[b])
        return not a | b or len(a & b) / len(a | b) >= least

    want = {(t, i) for t, i in pairs if any(u == t and (i == p or items[i][1:3] == items[p][1:3] or alike(i, p)) for u, p in positives)}
    assert got == want


def test_ten_thousand_positives_do_not_multiply(spark):
    """Pairs that are compared: those that share a rare token, not candidates times positives."""
    items = spark.range(10_500).select(F.col("id").alias("item_id"), F.format_string("t %d", "id").alias("title"), F.lit("b").alias("brand"), F.array(F.lit("common"), F.format_string("x%d", "id"), F.format_string("y%d", "id")).alias("tokens"))
    near = negatives.NearCopies(items.where("item_id < 10000").select(F.lit(1).alias("term_id"), "item_id"), items)
    candidates = items.where("item_id >= 9900").select(F.lit(1).alias("term_id"), "item_id")
    met = candidates.join(near.items, "item_id").select("term_id", F.explode("first").alias("t")).join(near.sets, ["term_id", "t"]).count()
    assert near(candidates).count() == 100 and met == 100
