"""Sparse top k of long texts takes little disk, and equals all products whatever the blocks and turns are."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchrank.operators import lineage, packed, retrieval

SPLIT = lambda c: F.split(c, " ")


def on_disk(spark):
    """Bytes of shuffles and checkpoints."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    local = sum(files.apply(k).length() for k in range(files.size()))
    return local + sum(p.stat().st_size for p in Path(lineage.shared_folder(spark).removeprefix("file:")).rglob("*") if p.is_file())


def all_products(queries, items, k, min_df=2):
    counts = {side: {d: Counter(t.split(" ")) for d, t in docs if t is not None} for side, docs in (("q", queries), ("i", items))}
    df = Counter(f for side in counts.values() for c in side.values() for f in c)
    n = len(queries) + len(items)
    idf = {f: math.log((1 + n) / (1 + x)) + 1 for f, x in df.items() if x >= min_df}

    def unit(c):
        w = {f: (1 + math.log(x)) * idf[f] for f, x in c.items() if f in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {f: x / norm for f, x in w.items()}

    vectors = {d: unit(c) for d, c in counts["i"].items()}
    out = set()
    for q, c in counts["q"].items():
        v = unit(c)
        found = [(-round(sum(x * w.get(f, 0) for f, x in v.items()), 7), i) for i, w in vectors.items()]
        out |= {(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(x for x in found if x[0] < 0)[:k])}
    return out


@pytest.mark.parametrize("x", [[], [0, 0], [1], [255, 256, 0], [2**64 - 1, 0, 2**40], list(range(3000))])
def test_packed_numbers_come_back(x):
    a, b = packed.unpack(packed.pack(np.array(x, np.uint64)) + packed.pack(np.array(x[::-1], np.uint64)))
    assert a.tolist() == x and b.tolist() == x[::-1]


@pytest.mark.parametrize(("k", "most", "turn"), [(3, 1 << 21, 1 << 20), (3, 40, 1), (50, 200, 30), (500, 40, 1 << 20)])
def test_blocks_and_turns_give_the_same_rows(spark, k, most, turn):
    """Equal texts in several blocks (ties to the id), null and empty texts, queries without a known feature, one word thousands of times."""
    deal = random.Random(4)
    text = lambda n: " ".join(f"w{int(deal.paretovariate(0.6)) % 300}" for _ in range(n))
    items = [(f"i{j:03d}", text(deal.randint(1, 30))) for j in range(200)]
    items += [(f"c{j}", items[7][1]) for j in range(9)] + [("n1", None), ("n2", ""), ("b", "w1 " * 3000 + "w2")]
    queries = [(j, text(6)) for j in range(30)] + [(90, None), (91, "unseen"), (92, items[7][1])]
    q, i = (spark.createDataFrame(rows, kind).repartition(3) for rows, kind in ((queries, "query_id int, text string"), (items, "item_id string, text string")))
    got = retrieval.packed_top_k(q, i, SPLIT(F.col("text")), k, digits=7, turn=turn, most=most)
    assert {(r.query_id, r.item_id, r.score, r["rank"]) for r in got.collect()} == all_products(queries, items, k)
    none = retrieval.packed_top_k(q.where("query_id = 91"), i, SPLIT(F.col("text")), k)
    assert none.columns == ["query_id", "item_id", "score", "rank"] and none.count() == 0


def test_long_texts_take_little_disk(spark):
    """Under 12 bytes for each feature of a document; as rows of 64-bit hashes they took 12 in one of several copies."""
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda j: F.concat(F.lit("w"), (F.xxhash64("item_id", j) % 40000).cast("string")))
    items = lineage.cut(spark.range(4000).select(F.col("id").alias("item_id")).select("item_id", F.concat_ws(" ", words).alias("text")).repartition(4))
    queries = items.where("item_id < 20").select(F.col("item_id").alias("query_id"), "text")
    before = on_disk(spark)
    assert retrieval.tfidf_top_k(queries, items, SPLIT, 5).count() == 100
    assert on_disk(spark) - before < 12 * 4000 * 400
