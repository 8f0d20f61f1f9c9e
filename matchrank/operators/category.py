"""Category priors of queries: a closed-form count prior and a logistic one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from matchrank.functions.text import category_levels, char_ngrams, normalize_text
from matchrank.operators.lineage import cut
from matchrank.operators.ranking import place, top_k
from matchrank.operators.retrieval import fit_tfidf

LEVELS = ("cat_l1", "cat_l2")


def category_examples(positives: DataFrame, terms: DataFrame, items: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct ``query_norm, cat_l1, cat_l2`` of positive pairs; unmatched ids drop out. ``most`` keeps
    that many in order of the query, as the sampling option that it is."""
    joined = positives.join(terms.select("term_id", "query"), "term_id").join(items.select("item_id", "category"), "item_id")
    out = joined.select(normalize_text(F.col("query")).alias("query_norm"), *[c.alias(n) for n, c in category_levels(F.col("category")).items() if n in LEVELS]).dropDuplicates(["query_norm", "cat_l2"])
    return out.orderBy("query_norm", "cat_l2").limit(most) if most else out


def class_filter(examples: DataFrame, label: str, least: int) -> DataFrame:
    """Examples of classes with ``least`` rows or more; if none has, those of the most frequent one."""
    counts = examples.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.orderBy(F.col("_n").desc(), label).limit(1)
    kept = counts.where(F.col("_n") >= least).select(label).unionByName(best.select(label)).distinct()
    top = F.broadcast(best.select((F.col("_n") >= least).alias("_any"), F.col(label).alias("_best")))
    allowed = kept.join(counts, label).crossJoin(top).where((F.col("_n") >= least) | (~F.col("_any") & (F.col(label) == F.col("_best")))).select(label)
    return examples.join(allowed, label, "left_semi")


def count_prior(examples: DataFrame, queries: DataFrame, label: str, tokens: Column, k: int = 5, digits: int = 9) -> DataFrame:
    """``term_id, label, prob, rank``: the mean over a query's known tokens of P(class | token)."""
    seen = examples.select(F.col(label).alias("label"), F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    given = seen.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("token"))).select("token", "label", "p")
    asked = queries.select("term_id", F.explode(F.array_distinct(tokens)).alias("token"))
    known = asked.join(given.select("token").distinct(), "token", "left_semi").groupBy("term_id").agg(F.count(F.lit(1)).alias("t"))
    sums = asked.join(given, "token").groupBy("term_id", "label").agg(F.sum("p").alias("s")).join(known, "term_id")
    return top_k(sums.select("term_id", "label", F.round(F.col("s") / F.col("t"), digits).alias("prob")), "term_id", "prob", "label", k)


def wide_top(top: DataFrame, level: str, k: int = 5) -> DataFrame:
    """``term_id, <level>_top1.., <level>_prob1..`` for a sink that wants one row per term."""
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    return top.groupBy("term_id").agg(*[at("label", r).alias(f"{level}_top{r}") for r in range(1, k + 1)], *[at("prob", r).alias(f"{level}_prob{r}") for r in range(1, k + 1)])


def lookup_arrays(top: DataFrame, level: str) -> DataFrame:
    """``term_id, <level>_labels, <level>_probs`` in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "label", "prob")))
    return top.groupBy("term_id").agg(rows.alias("x")).select("term_id", F.col("x.label").alias(f"{level}_labels"), F.col("x.prob").alias(f"{level}_probs"))


#: Examples of a shard, classes of a block and terms of a block at most; a shard's features and a block's
#: weights are what a task holds.
SHARD, CLASS_BLOCK, TERM_BLOCK = 1 << 16, 64, 1 << 16


def _segments(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of rows, features and weights of columns ``f`` and ``w``."""
    f = t.column("f").combine_chunks()
    offsets = f.offsets.to_numpy()
    return offsets - offsets[0], f.flatten().to_numpy(), t.column("w").combine_chunks().flatten().to_numpy()


def train_one_vs_rest(offsets: np.ndarray, features: np.ndarray, values: np.ndarray, ones: np.ndarray, weights: np.ndarray, epochs: int, rate: float, penalty: float, batch: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and biases of balanced logistic models, all classes of a block at once.

    Rows go by in their order in batches; each step is scaled by the root of the squared slopes so far.
    ``ones`` is rows x classes, ``weights`` what a class's own rows count.
    """
    width = int(features.max()) + 1 if len(features) else 0
    w, seen = np.zeros((width, ones.shape[1])), np.full((width, ones.shape[1]), 1e-8)
    bias, bias_seen = np.zeros(ones.shape[1]), np.full(ones.shape[1], 1e-8)
    for _ in range(epochs):
        for at in range(0, len(ones), batch):
            to = min(at + batch, len(ones))
            f, v = features[offsets[at] : offsets[to]], values[offsets[at] : offsets[to]]
            row = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
            margin = np.tile(bias, (to - at, 1))
            np.add.at(margin, row, w[f] * v[:, None])
            slope = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - ones[at:to]) * np.where(ones[at:to], weights, 1.0) / (to - at)
            used, place = np.unique(f, return_inverse=True)
            g = penalty * w[used]
            np.add.at(g, place, slope[row] * v[:, None])
            seen[used] += g * g
            w[used] -= rate * g / np.sqrt(seen[used])
            g = slope.sum(axis=0)
            bias_seen += g * g
            bias -= rate * g / np.sqrt(bias_seen)
    return w, bias


def logistic_prior(
    examples: DataFrame, queries: DataFrame, label: str, k: int = 5, max_features: int = 120_000, low: int = 2, high: int = 5, least: int = 2, epochs: int = 20, rate: float = 0.5, penalty: float = 2e-5
) -> DataFrame:
    """Like ``count_prior`` from TF-IDF of character n-grams and one balanced logistic model per class.

    Classes of fewer than ``least`` examples are left out. Example rows are written once and go to blocks of classes;
    a task trains a block's classes on a shard of the examples, shards are averaged, and weights stay a table with a row per
    block and feature: no matrix of classes and features is on the driver or in one task. Terms meet
    each block once, which passes on its best ``k`` and the sum of its scores; a class's probability is its
    score over the sum of all. A single class has probability 1, no example gives ``unknown``.
    """
    kept = cut(class_filter(examples, label, least).select("query_norm", F.col(label).alias("label")).distinct().withColumn("example", F.concat_ws("\x1f", "query_norm", "label")))
    sizes = cut(kept.groupBy("label").agg(F.count(F.lit(1)).alias("c")))
    classes, n = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    if classes < 2:
        only = sizes.first()
        return queries.select("term_id", F.lit(only["label"] if only else "unknown").alias("label"), F.lit(1.0).alias("prob"), F.lit(1).alias("rank"))
    grams = lambda c: char_ngrams(c, low, high)
    space = fit_tfidf([(kept, "example")], grams, 2 if n >= 2 else 1, max_features, "query_norm")
    vector = lambda long, key: long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("fid", "w"))).alias("x")).select(key, F.col("x.fid").alias("f"), F.col("x.w").alias("w"))
    numbered = place(sizes, F.col("label").asc(), out="n").select("label", (F.col("n") - 1).alias("y"), (F.lit(float(n)) / (classes * F.col("c"))).alias("own"))
    numbered = cut(numbered.withColumn("block", F.floor(F.col("y") / CLASS_BLOCK).cast("int")))
    shards, blocks = -(-n // SHARD), -(-classes // CLASS_BLOCK)
    rows = kept.join(vector(space.transform(kept, "example", "query_norm"), "example"), "example").join(numbered.select("label", "y"), "label")
    rows = cut(rows.select("example", "f", "w", "y", F.pmod(F.xxhash64("example"), F.lit(shards)).cast("int").alias("shard")))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    share = 1.0 / shards

    def train(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("y")
        ys, own, block = b.column("y").to_numpy(), b.column("own").to_numpy(), b.column("class_block")[0].as_py()
        a = a.sort_by("example")
        offsets, features, values = _segments(a)
        names, local = np.unique(features, return_inverse=True)
        w, bias = train_one_vs_rest(offsets, local, values, a.column("y").to_numpy()[:, None] == ys[None, :], own, epochs, rate, penalty)
        # the bias is the row without a feature
        stacked = np.vstack([w, bias]) * share
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, stacked.size + 1, len(ys)), pa.int32()), pa.array(stacked.ravel()))
        return pa.table({"block": pa.array(np.full(len(stacked), block, np.int32)), "fid": pa.array([*names.tolist(), None], pa.int64()), "v": flat})

    per_shard = numbered.select(F.col("block").alias("class_block"), "y", "own", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("class_shard"))
    trained = rows.select("*", every).groupBy("block", "shard").cogroup(per_shard.groupBy("class_block", "class_shard")).applyInArrow(train, "block int, fid long, v array<double>")
    if shards > 1:
        add = lambda s, x: F.zip_with(s, x, lambda p, q: p + q)
        trained = trained.groupBy("block", "fid").agg(F.collect_list("v").alias("all")).select("block", "fid", F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), add).alias("v"))
    asked = queries.select("term_id", "query_norm")
    terms = asked.select("term_id").distinct().join(vector(space.transform(asked, "term_id", "query_norm"), "term_id"), "term_id", "left")
    turns = max(1, -(-asked.count() // TERM_BLOCK))
    terms = terms.select("term_id", F.coalesce("f", F.array().cast("array<bigint>")).alias("f"), F.coalesce("w", F.array().cast("array<double>")).alias("w"), F.pmod(F.xxhash64("term_id"), F.lit(turns)).cast("int").alias("turn"))
    kind = queries.schema["term_id"].dataType
    schema = pa.schema([("term_id", to_arrow_type(kind)), ("y", pa.int64()), ("p", pa.float64())])

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        block, known = b.column("weight_block")[0].as_py(), b.column("fid").to_numpy(zero_copy_only=False)
        matrix = b.column("v").combine_chunks().flatten().to_numpy().reshape(b.num_rows, -1)
        bias = matrix[np.isnan(known.astype(float))][0]
        order = np.argsort(np.where(np.isnan(known.astype(float)), np.iinfo(np.int64).max, b.column("fid").fill_null(np.iinfo(np.int64).max).to_numpy()))
        ids = b.column("fid").fill_null(np.iinfo(np.int64).max).to_numpy()[order]
        out: list[list] = [[], [], []]
        for at in range(0, a.num_rows, 4096):
            part = a.slice(at, 4096).combine_chunks()
            offsets, features, values = _segments(part)
            i = np.minimum(np.searchsorted(ids, features), len(ids) - 1)
            hit = ids[i] == features
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets))[hit]
            margin = np.tile(bias, (part.num_rows, 1))
            for lo in range(0, len(row), 1 << 14):  # products in parts
                some = slice(lo, lo + (1 << 14))
                np.add.at(margin, row[some], matrix[order[i[hit][some]]] * values[hit][some][:, None])
            p = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
            best = np.argsort(-p, axis=1, kind="stable")[:, :k]
            terms_ = part.column("term_id").to_pylist()
            out[0] += [t for t in terms_ for _ in range(best.shape[1] + 1)]
            out[1] += np.hstack([best + block * CLASS_BLOCK, np.full((part.num_rows, 1), -1)]).ravel().tolist()
            out[2] += np.hstack([np.take_along_axis(p, best, 1), p.sum(axis=1, keepdims=True)]).ravel().tolist()
        return pa.table([pa.array(out[0], schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2])], schema=schema)

    weights = trained.select(F.col("block").alias("weight_block"), "fid", "v", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("weight_turn"))
    found = cut(terms.select("*", every).groupBy("block", "turn").cogroup(weights.groupBy("weight_block", "weight_turn")).applyInArrow(score, f"term_id {kind.simpleString()}, y long, p double"))
    totals = found.where("y < 0").groupBy("term_id").agg(F.sum("p").alias("total"))
    named = found.where("y >= 0").join(numbered.select("y", "label"), "y").join(totals, "term_id")
    return top_k(named.select("term_id", "label", (F.col("p") / F.col("total")).alias("prob")), "term_id", "prob", "label", k)
