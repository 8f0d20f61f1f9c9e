import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchrank.llm import boosting, components, quality, simhash, url_lists


def _counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]


def test_quality_counts_and_verdicts(spark, docs, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(all_docs, labels)
    for table in (docs, all_docs):
        texts = {r.doc_id: r.text or "" for r in table.collect()}
        for r in quality.score(table, model).collect():
            want = _counts(texts[r.doc_id])
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r.kept and r.base_failed)
    kept = quality.keep_documents(all_docs, model)
    assert kept.columns == all_docs.columns
    judged = quality.score(all_docs, model).where("NOT base_failed").join(labels, "doc_id")
    assert judged.where((F.col("quality") == 1) & ~F.col("kept")).count() <= 0.01 * judged.count()
    assert judged.where((F.col("quality") == 0) & F.col("kept")).count() <= 0.2 * max(1, judged.where("quality = 0").count())
    assert quality.score(empty, model).count() == 0 and quality.keep_documents(empty, model).count() == 0


def test_quality_without_labels_keeps_what_the_rules_keep(docs):
    model = quality.fit(docs, docs.select("doc_id", F.lit(None).cast("int").alias("quality")))
    assert all(r.kept != r.base_failed for r in quality.score(docs, model).collect())


def test_forest_is_monotone_and_flat():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] - 0.5 * np.sin(3 * x[:, 0]) + 0.3 * rng.normal(size=3000) + x[:, 1] ** 2 > 0.5).astype(float)
    forest = boosting.fit(x[:2000], y[:2000], np.array([1, 0, -1]), trees=40)
    held = forest.probability(x[2000:])
    assert ((held > 0.5) == (y[2000:] > 0)).mean() > 0.85
    line = np.zeros((200, 3))
    line[:, 0] = np.linspace(-4, 4, 200)
    assert (np.diff(forest.probability(line)) >= -1e-12).all()

    def walk(root, row):  # one row, one tree, node by node
        at = root
        while forest.left[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        return forest.value[at]

    for row in x[:20]:
        assert forest.raw(row[None])[0] == pytest.approx(forest.bias + sum(walk(r, row) for r in forest.roots))
    assert boosting.fit(x[:0], y[:0], np.zeros(3)).probability(x[:2]) == pytest.approx([0.5, 0.5])


def _brute(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in ids}


def test_simhash_rows(docs, empty):
    import xxhash

    got = {r.doc_id: r for r in simhash.near_duplicates(docs, words=4).collect()}
    prints = {}
    for r in docs.collect():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")]
        grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
        prints[r.doc_id] = sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))
    assert {i: got[i].fingerprint for i in prints} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: got[i].component_id for i in prints} == _brute(prints)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 5, 7, 10}


def _nodes(spark, prints):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return spark.createDataFrame([(signed(p), i) for i, p in prints.items()], "fp long, rep long")


def _family(rng, size):
    """Fingerprints of one text's near copies: few bits from a common one, far from it in all."""
    centre, out = rng.getrandbits(64), set()
    while len(out) < size:
        p = centre
        for b in rng.sample(range(64), rng.randint(1, 7)):
            p ^= 1 << b
        out.add(p)
    return sorted(out)


@pytest.mark.parametrize("held", [2, 64])
def test_links_lose_nothing(spark, monkeypatch, held):
    """Random prints, planted chains and a tight family, mostly in memory and mostly by points."""
    monkeypatch.setattr(simhash, "HELD", held)
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(120):
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            p ^= 1 << b
        prints.append(p)
    prints = {100 + i: p for i, p in enumerate(dict.fromkeys(prints))}
    found = {r.node: r.component for r in components.components(simhash.links(_nodes(spark, prints))).collect()}
    assert {i: found.get(i, i) for i in prints} == _brute(prints)


def test_links_of_a_family_grow_with_its_size(spark):
    """A thousand near copies: all classes right, and the cells give rows in proportion to members."""
    prints = {7 * i: p for i, p in enumerate(_family(random.Random(5), 1000))}
    found = {r.node: r.component for r in components.components(simhash.links(_nodes(spark, prints))).collect()}
    assert {i: found.get(i, i) for i in prints} == _brute(prints)
    cells = [[(i, p) for i, p in prints.items()][k : k + 64] for k in range(0, 1000, 64)]
    held = spark.createDataFrame([([(i, p - (1 << 64) if p >> 63 else p) for i, p in c],) for c in cells], "all array<struct<rep:long,fp:long>>")
    assert simhash._stars(held).count() < 1000


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(edges.where("false")).count() == 0


def test_url_lists_as_of(spark):
    log = [
        ("example.com", "spam", "add", "2024-01-10"),
        ("example.com", "spam", "add", "2024-01-20"),
        ("example.com", "spam", "remove", "2024-03-01"),
        ("sub.example.com", "adult", "add", "2024-02-15"),
        ("other.org/ads", None, "add", "2024-01-01"),
        ("gone.net", "spam", "remove", "2024-01-01"),
        (None, "spam", "add", "2024-01-01"),
    ]
    entries = spark.createDataFrame(log, "rule string, category string, action string, at string").withColumn("listed_at", F.to_timestamp("at"))
    seen = [
        (1, "http://www.example.com/x", "2024-01-09"),
        (2, "https://user@Example.COM:80/x", "2024-01-10"),
        (3, "http://a.sub.example.com", "2024-02-20"),
        (4, "http://a.sub.example.com", "2024-03-01"),
        (5, "http://other.org/ads/banner", "2024-06-01"),
        (6, "http://other.org/news", "2024-06-01"),
        (7, None, "2024-06-01"),
        (8, "http://gone.net/", None),
        (9, "http://notexample.com/", "2024-02-01"),
    ]
    captures = spark.createDataFrame(seen, "page_id long, url string, at string").withColumn("fetched_at", F.to_timestamp("at")).withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.blocked, r.rule, r.categories) for r in url_lists.evaluate(captures, url_lists.intervals(entries)).collect()}
    no = (False, "", "")
    assert got == {
        1: no, 2: (True, "example.com", "spam"), 3: (True, "sub.example.com", "adult,spam"), 4: (True, "sub.example.com", "adult"),
        5: (True, "other.org/ads", "listed"), 6: no, 7: no, 8: no, 9: no,
    }
    assert url_lists.evaluate(captures.where("false"), url_lists.intervals(entries)).count() == 0
    assert not any(r.blocked for r in url_lists.evaluate(captures, url_lists.intervals(entries.where("false"))).collect())


def test_url_rules_of_any_depth_and_case(spark):
    log = [("deep.org/a/b/c/d/e", "spam"), ("Case.COM/Ads", "spam"), ("deep.org/a/b/c/d", "adult")]
    entries = spark.createDataFrame(log, "rule string, category string").withColumn("action", F.lit("add")).withColumn("listed_at", F.to_timestamp(F.lit("2024-01-01")))
    seen = [(1, "http://www.deep.org/a/b/c/d/e/f?x"), (2, "http://deep.org/a/b/c/d/g"), (3, "http://deep.org/a/b/c"), (4, "http://case.com/Ads/1"), (5, "http://CASE.com/ads/1")]
    captures = spark.createDataFrame(seen, "page_id long, url string").withColumn("fetched_at", F.to_timestamp(F.lit("2024-02-01")))
    got = {r.page_id: (r.rule, r.categories) for r in url_lists.evaluate(captures, url_lists.intervals(entries)).collect()}
    assert got == {1: ("deep.org/a/b/c/d/e", "adult,spam"), 2: ("deep.org/a/b/c/d", "adult"), 3: ("", ""), 4: ("case.com/Ads", "spam"), 5: ("", "")}
