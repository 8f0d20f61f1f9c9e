"""Grouped folds and splits; every random choice is an order by SHA-256, the same in any layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchrank.functions.numeric import stable_hash
from matchrank.operators.ranking import place, quantile_bins
from matchrank.sources.contracts import ContractError, require_binary, require_columns, require_unique

# the group tables here have one row per term: windows over them see terms, not pairs


def _hash(key: str, seed: str) -> F.Column:
    return stable_hash(seed, F.col(key).cast("string"))


def sample_at_most(df: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """The first ``n`` rows in hash order of a unique key."""
    return df.withColumn("_h", _hash(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def term_folds(positives: DataFrame, k: int = 5, bins: int = 5, seed: str = "fold", key: str = "term_id") -> DataFrame:
    """``key, n_positives, bin, fold``: terms binned by their counts, dealt round robin in hash order.

    The round robin runs on from bin to bin, so fold sizes differ by one at most.
    """
    counts = positives.groupBy(key).agg(F.count(F.lit(1)).alias("n_positives")).withColumn("_h", _hash(key, seed))
    w = Window.partitionBy()
    r = F.row_number().over(w.orderBy("n_positives", "_h"))
    place = F.ceil((r - 1) * bins / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))) - 1
    binned = counts.withColumn("bin", F.greatest(place, F.lit(0)).cast("int"))
    return binned.withColumn("fold", ((F.row_number().over(Window.orderBy("bin", "_h")) - 1) % k).cast("int")).drop("_h")


def split_manifest(positives: DataFrame, mode: str, k: int = 5, seed: str = "fold", key: str = "term_id") -> DataFrame:
    """``pilot``: fold 0 of k is held out; ``confirm``: k folds; ``final``: fold -1, nothing held out."""
    folds = term_folds(positives, k, seed=seed, key=key)
    if mode == "final":
        return folds.select(key, "n_positives", F.lit(-1).alias("fold"), F.lit("final").alias("split"))
    if mode == "pilot":
        held = F.col("fold") == 0
        return folds.select(key, "n_positives", F.when(held, 0).otherwise(1).alias("fold"), F.when(held, "outer_holdout").otherwise("outer_train").alias("split"))
    if mode == "confirm":
        return folds.select(key, "n_positives", "fold", F.lit("outer_fold").alias("split"))
    raise ValueError(mode)


def inner_split(rows: DataFrame, share: float = 0.1, seed: str = "inner", key: str = "term_id") -> DataFrame:
    """``rows`` with ``is_valid``: the first round(terms * share) terms in hash order, at least one."""
    terms = rows.select(key).distinct().withColumn("_h", _hash(key, seed))
    r, n = F.row_number().over(Window.orderBy("_h", key)), F.count(F.lit(1)).over(Window.partitionBy())
    marks = terms.select(key, (r <= F.greatest(F.bround(n * share).cast("long"), F.lit(1))).alias("is_valid"))
    return rows.join(marks, key)


def hold_out(rows: DataFrame, manifest: DataFrame, fold: int, key: str = "term_id") -> tuple[DataFrame, DataFrame]:
    """Training rows and held-out rows of a fold; terms never cross."""
    held = manifest.where(F.col("fold") == fold).select(key)
    return rows.join(held, key, "left_anti"), rows.join(held, key, "left_semi")


def stratified_rows(rows: DataFrame, share: float, key: str, label: str = "label", seed: str = "rows") -> DataFrame:
    """``is_valid`` for round(share) of each label's rows in hash order.

    One order over label, hash and key; a label's rows begin where the smaller labels' end, so a label
    that most rows have is spread over tasks. Labels are few: their counts are broadcast.
    """
    placed = place(rows, F.col(label).asc(), _hash(key, seed).asc(), F.col(key).asc(), out="_p")
    counts = placed.groupBy(F.col(label).alias("_l")).agg((F.min("_p") - 1).alias("_before"), F.bround(F.count(F.lit(1)) * share).alias("_quota"))
    return placed.join(F.broadcast(counts), F.col(label).eqNullSafe(F.col("_l"))).withColumn("is_valid", F.col("_p") - F.col("_before") <= F.col("_quota")).select(*rows.columns, "is_valid")


def row_split(rows: DataFrame, share: float, key: str, seed: str = "rows") -> DataFrame:
    """``is_valid`` where the hash, read as a fraction, lies below ``share``: no sort, no shuffle."""
    first = F.conv(F.substring(_hash(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.withColumn("is_valid", first < share)


def labelled_sample(rows: DataFrame, most: int, key: str, label: str = "label", seed: str = "sample") -> DataFrame:
    """At most ``most`` rows with the share of positives kept and one negative at least, hash order.

    The quotas come from two counts; each is then a top-k, of which every task keeps its own part.
    """
    total, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()
    if total <= most:
        return rows
    quota = min(round(most * positive / total), most - 1)
    return sample_at_most(rows.where(F.col(label) == 1), quota, key, seed).unionByName(sample_at_most(rows.where(F.col(label) != 1), most - quota, key, seed))


def stratified_audit(rows: DataFrame, n: int, buckets: int, band: str, score: str, key: str, seed: str = "audit") -> DataFrame:
    """Per band: quantile buckets of the score, ceil(n / buckets) of each in hash order, ``n`` in all."""
    binned = quantile_bins(rows, score, key, buckets, "score_bucket", band)
    each = -(-n // buckets)
    h = _hash(key, seed)
    r = F.row_number().over(Window.partitionBy(band, "score_bucket").orderBy(h, key))
    some = binned.withColumn("_r", r).where(F.col("_r") <= each)
    cap = F.row_number().over(Window.partitionBy(band).orderBy("_r", "score_bucket"))
    return some.withColumn("_c", cap).where(F.col("_c") <= n).drop("_r", "_c")


def slate_split(slate: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows of a slate by its own ``fold``, after its contract is checked: distinct
    ``slate_id``, binary labels, one fold per term, both sides and both labels present."""
    require_unique(require_columns(slate, "slate_id", "term_id", "item_id", "label", "fold"), "slate_id")
    require_binary(slate, "label", both=True)
    require_unique(slate.select("term_id", "fold").distinct(), "term_id")
    train, held = slate.where(F.col("fold") != fold), slate.where(F.col("fold") == fold)
    for name, side in (("training", train), ("held-out", held)):
        if side.limit(1).count() == 0:
            raise ContractError(f"no {name} rows for fold {fold}")
    return train, held
