"""Negatives: score bands, rank bands, near-duplicate filters, calibrated bands, batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from matchrank.functions.numeric import jaccard, stable_hash
from matchrank.operators.draws import draw, placed
from matchrank.operators.lineage import cut, sorted_join
from matchrank.operators.ranking import quantiles
from matchrank.operators.splits import sample_at_most
from matchrank.sources.contracts import ContractError, require_columns, require_disjoint, require_range, require_unique

# fixed values: half-open score bands and their sizes
SCORE_BANDS = {"low": (float("-inf"), 2.0, 350_000), "mid": (2.0, 4.5, 350_000), "hard": (4.5, 6.5, 150_000)}


def minus_positives(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """Distinct candidate pairs that aren't positive."""
    return candidates.dropDuplicates(["term_id", "item_id"]).join(sorted_join(positives.select("term_id", "item_id")), ["term_id", "item_id"], "left_anti")


def score_bands(scored: DataFrame, bands: dict[str, tuple[float, float, int]] = SCORE_BANDS, seed: str = "band", key: str = "id", allow: bool = True, closed_above: bool = False) -> DataFrame:
    """Rows of each band, at most its size in hash order; ``band`` names it. ``closed_above`` takes
    (low, high] instead of [low, high)."""
    if not allow:
        raise ContractError("unlabelled candidates as negatives aren't allowed here")
    inside = lambda lo, hi: ((F.col("score") > lo) & (F.col("score") <= hi)) if closed_above else ((F.col("score") >= lo) & (F.col("score") < hi))
    once = scored.dropDuplicates([key])
    return reduce(lambda a, b: a.unionByName(b), [sample_at_most(once.where(inside(lo, hi)).withColumn("band", F.lit(name)), n, key, f"{seed}+{k}") for k, (name, (lo, hi, n)) in enumerate(bands.items())])


def calibrated_bounds(positive_scores: DataFrame, score: str = "score") -> DataFrame:
    """Band borders from the positives' 10, 25 and 50 % quantiles, each at least .01 above the last."""
    q = quantiles(positive_scores, score, {"q10": 0.10, "q25": 0.25, "q50": 0.50})
    low = q.withColumn("low", F.greatest(F.lit(0.005), 0.6 * F.col("q10")))
    mid = low.withColumn("mid", F.greatest(F.col("low") + 0.01, 0.8 * F.col("q25")))
    return mid.withColumn("hard", F.greatest(F.col("mid") + 0.01, 0.9 * F.col("q50")))


def calibrated_bands(scored: DataFrame, positive_scores: DataFrame, positives: DataFrame, targets: dict[str, int], seed: str = "calibrated", key: str = "id", score: str = "score") -> DataFrame:
    """``key, term_id, item_id, score, negative_band``: at most ``targets[band]`` rows per band in hash order.

    Bands are (0, low], (low, mid], (mid, hard] with the borders of ``calibrated_bounds``; no row is a
    positive pair or comes twice.
    """
    borders = F.broadcast(calibrated_bounds(positive_scores, score).select("low", "mid", "hard"))
    free = minus_positives(scored, positives).crossJoin(borders)
    s = F.col(score)
    band = F.when((s > 0) & (s <= F.col("low")), "low").when((s > F.col("low")) & (s <= F.col("mid")), "mid").when((s > F.col("mid")) & (s <= F.col("hard")), "hard")
    named = free.withColumn("negative_band", band).where("negative_band IS NOT NULL").select(key, "term_id", "item_id", score, "negative_band")
    return reduce(lambda a, b: a.unionByName(b), [sample_at_most(named.where(F.col("negative_band") == b), n, key, f"{seed}+{b}") for b, n in targets.items()])


def _order(term: str, item: str, seed: str) -> Column:
    return stable_hash(seed, F.col(term).cast("string"), F.col(item).cast("string"))


def tfidf_bands(ranked: DataFrame, positives: DataFrame, items: DataFrame, hard: int = 25, mid: int = 15, easy: int = 10, seed: str = "tfidf") -> DataFrame:
    """From retrieved rows (``term_id, item_id, score, rank``): the first non-positives are hard, some
    of the rest by hash mid, and items outside retrieval and positives easy.

    Easy items are the first ``easy`` free ones of the term's own random order of the catalog
    (``draws.draw``); too few of them are an error.
    """
    free = minus_positives(ranked, positives)
    w = Window.partitionBy("term_id")
    place = F.row_number().over(w.orderBy("rank"))
    hard_rows = free.withColumn("p", place)
    hard_out = hard_rows.where(F.col("p") <= hard).select("term_id", "item_id", F.lit("hard").alias("negative_band"), F.col("score").alias("tfidf_score"))
    rest = hard_rows.where(F.col("p") > hard).withColumn("r", F.row_number().over(w.orderBy(_order("term_id", "item_id", seed), "item_id")))
    mid_out = rest.where(F.col("r") <= mid).select("term_id", "item_id", F.lit("mid").alias("negative_band"), F.col("score").alias("tfidf_score"))
    taken = ranked.select("term_id", "item_id").unionByName(positives.select("term_id", "item_id").join(sorted_join(ranked.select("term_id").distinct()), "term_id", "left_semi")).distinct()
    easy_out = uniform(taken, items, easy, seed + "-easy").select("term_id", "item_id", F.lit("easy").alias("negative_band"), F.lit(0.0).alias("tfidf_score"))
    return hard_out.unionByName(mid_out).unionByName(easy_out)


def uniform(taken: DataFrame, items: DataFrame, n: int | Column, seed: str, reject: Callable[[DataFrame], DataFrame] | None = None, short: str = "raise") -> DataFrame:
    """Per term of ``taken`` the first ``n`` items of its own random order that ``taken`` doesn't hold and
    ``reject`` lets through; ``term_id, item_id, pick``. A catalog too small is an error (``draws.draw``)."""
    return draw(taken.select("term_id").distinct().withColumn("n", F.lit(n).cast("long")), taken, items, seed, reject, short)


class NearCopies:
    """Which pairs are near copies of the term's positives, without comparing all of both.

    An item is one if it is a positive of the term, shares title and brand with one, or has a title-token
    Jaccard of ``least`` or more with one. Equal items and titles are equality joins. For Jaccard, tokens
    are put in order of rarity over the catalog: two sets that similar share a token among the first
    ``n - ceil(least * n) + 1`` of each and differ little in length, so pairs meet on (term, such a token) and only
    these are compared. Items equal but for their id are one ``kind``, under the least id, and are compared once;
    positives of equal titles stand for one. ``items``: item_id, title, brand, tokens.
    """

    def __init__(self, positives: DataFrame, items: DataFrame, least: float = 0.9):
        self.least = least
        once = items.select("item_id", "title", "brand", F.array_distinct("tokens").alias("tokens"))
        kinds = cut(once.groupBy("title", "brand", "tokens").agg(F.min("item_id").alias("kind"), F.count(F.lit(1)).alias("n")))
        like = kinds.select("kind", *[F.col(c).alias(f"k_{c}") for c in ("title", "brand", "tokens")])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in ("title", "brand", "tokens")])
        self.members = cut(once.join(sorted_join(like), same).select("item_id", "kind"))
        each = kinds.select("kind", "n", F.explode("tokens").alias("t"))
        rarity = each.groupBy("t").agg(F.sum("n").alias("df"))
        ordered = each.join(sorted_join(rarity), "t").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("df", "t")))["t"].alias("o"))
        first = F.slice("o", F.lit(1), (F.size("o") - F.ceil(F.lit(least) * F.size("o") - 1e-9) + 1).cast("int"))
        # two empty titles are equal: they meet on a token that no title has
        none = F.array(F.lit(""))
        self.kinds = cut(kinds.join(sorted_join(ordered), "kind", "left").select("kind", "title", "brand", "tokens", F.coalesce(first, none).alias("first")))
        self.positives = cut(positives.select("term_id", "item_id").distinct())
        facts = self.positives.join(sorted_join(self.members), "item_id").select("term_id", "kind").distinct().join(sorted_join(self.kinds), "kind")
        self.titles = cut(facts.select("term_id", "title", "brand").distinct())
        self.sets = cut(facts.select("term_id", F.array_sort("tokens").alias("p"), F.array_sort("first").alias("f")).distinct().select("term_id", "p", F.explode("f").alias("t")))

    @cached_property
    def items(self) -> DataFrame:
        """The facts of each item: ``item_id, title, brand, tokens, first``."""
        return self.members.join(sorted_join(self.kinds), "kind").drop("kind")

    def __call__(self, candidates: DataFrame) -> DataFrame:
        """The pairs ``term_id, item_id`` of ``candidates`` that are near copies."""
        pairs = cut(candidates.select("term_id", "item_id").distinct().join(sorted_join(self.members), "item_id", "left"))
        both = cut(pairs.select("term_id", "kind").distinct().join(sorted_join(self.kinds), "kind"))
        same = pairs.join(sorted_join(self.positives), ["term_id", "item_id"], "left_semi").select("term_id", "item_id")
        titled = both.join(sorted_join(self.titles), ["term_id", "title", "brand"], "left_semi").select("term_id", "kind")
        met = both.select("term_id", "kind", "tokens", F.explode("first").alias("t")).join(sorted_join(self.sets), ["term_id", "t"])
        small, large = F.least(F.size("tokens"), F.size("p")), F.greatest(F.size("tokens"), F.size("p"))
        alike = met.where((small >= self.least * large - 1e-9) & (jaccard(F.col("tokens"), F.col("p")) >= self.least)).select("term_id", "kind")
        near = pairs.join(sorted_join(titled.unionByName(alike).distinct()), ["term_id", "kind"]).select("term_id", "item_id")
        return same.unionByName(near).distinct()


def near_duplicates_of_positives(candidates: DataFrame, positives: DataFrame, items: DataFrame, least: float = 0.9) -> DataFrame:
    """Candidate pairs that are near copies of a positive of their term (``NearCopies``)."""
    return NearCopies(positives, items, least)(candidates)


def without_near_duplicates(candidates: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return candidates.join(sorted_join(near(candidates)), ["term_id", "item_id"], "left_anti")


def rank_band(pool: DataFrame, chosen: DataFrame | None, low: int, high: int, n: int, source: str, seed: str) -> DataFrame:
    """``n`` rows per term of ranks low..high by hash, those already chosen left out, in rank order."""
    rows = pool.where(F.col("rank").between(low, high))
    if chosen is not None:
        rows = rows.join(sorted_join(chosen.select("term_id", "item_id")), ["term_id", "item_id"], "left_anti")
    r = F.row_number().over(Window.partitionBy("term_id").orderBy(_order("term_id", "item_id", seed), "item_id"))
    return rows.withColumn("_r", r).where(F.col("_r") <= n).select("term_id", "item_id", F.lit(source).alias("negative_source"), F.col("rank").alias("source_rank"), F.col("score").alias("source_score"))


def rank_band_negatives(lexical: DataFrame, embedding: DataFrame, positives: DataFrame, items: DataFrame, low: int, high: int, each: int, seed: str = "mine", uniform_rows: int = 0) -> DataFrame:
    """Uniform rows first if asked, then ``each`` from the lexical band, then from the embedding band,
    each stage without what came before; bands that fall short are filled uniformly per family.

    No row of any source, uniform ones included, is a positive of its term or a near copy of one; a
    catalog too small for that is an error. Each stage is checkpointed, as the next ones refer to it
    several times."""
    near = NearCopies(positives, items)
    safe = lambda pool: without_near_duplicates(minus_positives(pool, positives), near)
    terms = positives.select("term_id").distinct()
    base = near.positives
    items = placed(items)
    blank = lambda rows, source: rows.select("term_id", "item_id", F.lit(source).alias("negative_source"), F.lit(0).alias("source_rank"), F.lit(0.0).alias("source_score"))
    out = None
    if uniform_rows:
        out = cut(blank(uniform(base, items, uniform_rows, seed + "-uniform", near), "uniform"))
    for family, pool in (("lexical", lexical), ("embedding", embedding)):
        some = cut(rank_band(safe(pool.where(F.col("rank").between(low, high))), out, low, high, each, family, f"{seed}-{family}"))
        out_now = some if out is None else out.unionByName(some)
        short = terms.join(sorted_join(some.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))), "term_id", "left").select("term_id", (each - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
        taken = cut(base.unionByName(out_now.select("term_id", "item_id")).distinct())
        fill = draw(short, taken, items, f"{seed}-fill-{family}", near)
        out = cut(out_now.unionByName(blank(fill, f"uniform_backfill_{family}")))
    return out


def check_negatives(rows: DataFrame, positives: DataFrame, low: int, high: int) -> DataFrame:
    """No repeats, no positives, ranks in the band."""
    require_unique(rows, "term_id", "item_id")
    require_disjoint(rows, positives, "term_id", "item_id")
    require_range(rows.where("source_rank > 0"), "source_rank", low, high)
    return rows


def negative_audit(rows: DataFrame) -> DataFrame:
    """One row ``value``: a JSON document of rows, terms, rows per source, rank span, score span."""
    by_source = rows.groupBy("negative_source").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("negative_source", "n")))).alias("by_source"))
    ranked = F.when(F.col("source_rank") > 0, F.col("source_rank"))
    facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("term_id").alias("terms"), F.min(ranked).alias("least_rank"), F.max(ranked).alias("greatest_rank"), F.round(F.min("source_score"), 9).alias("least_score"), F.round(F.max("source_score"), 9).alias("greatest_score"))
    return facts.crossJoin(F.broadcast(by_source)).select(F.to_json(F.struct("*")).alias("value"))


def external_negatives(rows: DataFrame, positives: DataFrame) -> DataFrame:
    """Distinct pairs of a file of negatives that aren't positive; none left is an error."""
    out = minus_positives(require_columns(rows, "term_id", "item_id"), positives)
    if out.limit(1).count() == 0:
        raise ContractError("no negatives are left")
    return out


def _seed(*parts: object) -> int:
    """The first eight bytes of the parts' hash, little-endian (``numeric.stable_seed``)."""
    return int.from_bytes(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()[:8], "little")


def assemble_batches(rows: DataFrame, pool: DataFrame, catalog: DataFrame, seed: int = 42, epoch: int = 0, multiple: int = 3, semi_hard: bool = True) -> DataFrame:
    """Candidates of training batches: ``batch, position, row_index, item_id, source``.

    ``rows`` is ``batch, row_index, term_id, item_id``, any number of batches of a size that a task holds;
    ``pool`` is ``term_id, family, item_ids`` (``negative_pool``). Per batch, in order: the rows' own items
    by row and item (``positive``), then one semi-hard item per row, then ``multiple`` times as many shared uniform
    items. A row takes its semi-hard item from the lexical family if row and epoch sum to an even number, else
    from the embedding one, then from the other, then from the uniform family, then from the catalog
    (``uniform_backfill``); a family's list is entered at a place that seed, epoch and row fix. No item after
    the positives repeats another of its batch. Uniform items are the batch's own draws; a catalog too small
    is an error. ``row_index`` is null for uniform items.
    """
    families = ("lexical", "embedding", "uniform")
    lists = pool.groupBy("term_id").agg(*[F.max(F.when(F.col("family") == f, F.col("item_ids"))).alias(f) for f in families])
    kind = rows.schema["item_id"].dataType
    # as many draws as can be needed, and as can fall on items that are taken by then
    sizes = rows.groupBy(F.col("batch").alias("term_id")).agg((F.count(F.lit(1)) * (multiple + (3 if semi_hard else 1))).alias("n"))
    none = rows.select(F.col("batch").alias("term_id"), "item_id").where("false")
    drawn = draw(sizes, none, catalog, f"{seed}-{epoch}-batch", short="fewer").select(F.col("term_id").alias("draw_batch"), "pick", F.col("item_id").alias("drawn_id"))
    schema = pa.schema([("batch", to_arrow_type(rows.schema["batch"].dataType)), ("position", pa.int32()), ("row_index", pa.int64()), ("item_id", to_arrow_type(kind)), ("source", pa.string())])

    def assemble(batch: pa.Table, draws: pa.Table) -> pa.Table:
        own = batch.sort_by([("row_index", "ascending"), ("item_id", "ascending")]).to_pylist()
        if not own:
            return schema.empty_table()
        free = iter(draws.sort_by("pick").column("drawn_id").to_pylist())
        out = [(r["row_index"], r["item_id"], "positive") for r in own]
        taken = {r["item_id"] for r in own}

        def take(row: int | None, source: str) -> None:
            item = next((i for i in free if i not in taken), None)
            if item is None:
                raise ContractError(f"the catalog is too small for batch {own[0]['batch']!r}")
            taken.add(item)
            out.append((row, item, source))

        for r in own if semi_hard else ():
            index = r["row_index"]
            first = "lexical" if (index + epoch) % 2 == 0 else "embedding"
            for family in (first, "embedding" if first == "lexical" else "lexical", "uniform"):
                values = r[family] or []
                at = _seed(seed, epoch, index, family) % len(values) if values else 0
                if (item := next((i for i in values[at:] + values[:at] if i not in taken), None)) is not None:
                    taken.add(item)
                    out.append((index, item, family))
                    break
            else:
                take(index, "uniform_backfill")
        for _ in range(multiple * len(own)):
            take(None, "uniform")
        rows_, items_, sources = zip(*out, strict=True)
        return pa.table([pa.array([own[0]["batch"]] * len(out), schema.field(0).type), pa.array(range(len(out)), pa.int32()), pa.array(rows_, pa.int64()), pa.array(items_, schema.field(3).type), pa.array(sources)], schema=schema)

    sides = rows.select("batch", F.col("row_index").cast("long").alias("row_index"), "term_id", "item_id").join(lists, "term_id", "left").drop("term_id")
    return sides.groupBy("batch").cogroup(drawn.groupBy("draw_batch")).applyInArrow(assemble, f"batch {rows.schema['batch'].dataType.simpleString()}, position int, row_index long, item_id {kind.simpleString()}, source string")


def known_positive_mask(rows: DataFrame, candidates: DataFrame, positives: DataFrame, batch: str = "batch") -> DataFrame:
    """``row_index, item_id, masked``: a candidate that is another positive of the row's term.

    Rows meet the candidates of their own ``batch`` (a column of both): a batch's size bounds the pairs.
    """
    pairs = rows.select(batch, "row_index", "term_id", F.col("item_id").alias("target")).join(candidates.select(batch, "item_id").distinct(), batch)
    known = pairs.join(positives.select("term_id", "item_id", F.lit(True).alias("k")), ["term_id", "item_id"], "left")
    return known.select("row_index", "item_id", (F.coalesce("k", F.lit(False)) & (F.col("item_id") != F.col("target"))).alias("masked"))


def negative_pool(negatives: DataFrame, family: Column) -> DataFrame:
    """``term_id, family, item_ids`` in id order."""
    return negatives.groupBy("term_id", family.alias("family")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def training_frame(positives: DataFrame, negatives: DataFrame, most_positives: int | None = None, most_negatives: int | None = None, seed: str | None = None) -> DataFrame:
    """Positives as 1 and the negatives that aren't positive as 0.

    Limits keep the first pairs in hash order; with a ``seed`` a column ``shuffle`` gives each row its
    place's key in a repeatable random order.
    """
    key = F.concat_ws("\x1f", F.col("term_id").cast("string"), F.col("item_id").cast("string"))

    def some(df: DataFrame, most: int | None, name: str) -> DataFrame:
        return df if most is None else sample_at_most(df.withColumn("_k", key), most, "_k", name).drop("_k")

    ones = some(positives.select("term_id", "item_id").distinct(), most_positives, "positives").withColumn("label", F.lit(1))
    zeros = some(minus_positives(negatives.select("term_id", "item_id"), positives), most_negatives, "negatives").withColumn("label", F.lit(0))
    out = ones.unionByName(zeros)
    return out if seed is None else out.withColumn("shuffle", stable_hash(seed, key))
