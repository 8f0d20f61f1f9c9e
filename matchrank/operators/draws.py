"""Uniform draws without a cross product: each term goes through the catalog in a random order of its own.

The order is a keyed permutation of catalog positions: a small Feistel network over a grid of about
sqrt(N) x sqrt(N) cells, whose round keys come from the term's own hash. Orders of different terms are
independent, a term meets each position once, and its next position costs some integer arithmetic, so
as many steps are made as the term needs; cells beyond the catalog's end are passed over.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchrank.functions.numeric import stable_hash
from matchrank.operators.lineage import cut, sorted_join
from matchrank.operators.ranking import place
from matchrank.sources.contracts import ContractError

# fixed values: the round function's multipliers and shifts over 31-bit numbers
ROUNDS, SPAN, MIX_1, MIX_2, SHIFT_1, SHIFT_2 = 6, 1 << 31, 1_540_483_477, 1_103_515_245, 13, 16
#: By how much the steps grow from one round of draws to the next.
GROWTH = 8


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with ``n`` cells or more."""
    a = isqrt(max(n - 1, 0)) + 1
    return a, -(-n // a) or 1


def round_keys(seed: str, term: Column) -> Column:
    """The term's array of 31-bit keys."""
    h = stable_hash(seed, term.cast("string"))
    return F.array(*[F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") % SPAN for k in range(ROUNDS)])


def permuted(step: Column, keys: Column, n: int) -> Column:
    """Where the permutation of the grid for ``n`` positions takes ``step``: each round adds a mix of one
    coordinate to the other, which its sides undo, so different steps stay different."""
    a, b = grid(n)
    left, right = F.floor(step / b).cast("long"), (step % b).cast("long")

    def mixed(x: Column, k: int) -> Column:
        y = (x * MIX_1 + F.get(keys, F.lit(k))) % SPAN
        y = (y.bitwiseXOR(F.shiftright(y, SHIFT_1)) * MIX_2) % SPAN
        return y.bitwiseXOR(F.shiftright(y, SHIFT_2))

    def turn(k: int) -> Callable[[Column], Column]:
        if k % 2 == 0:
            return lambda p: F.struct(((p["l"] + mixed(p["r"], k)) % a).alias("l"), p["r"].alias("r"))
        return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + mixed(p["l"], k)) % b).alias("r"))

    # each round is bound once, else its expression would be repeated in the next
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    pair = F.struct(left.alias("l"), right.alias("r"))
    for k in range(ROUNDS):
        pair = let(pair, turn(k))
    return let(pair, lambda p: p["l"] * b + p["r"])


def placed(items: DataFrame) -> DataFrame:
    """``place, item_id``: the catalog in id order from 0, written, so that several draws can share it."""
    return cut(place(items.select("item_id").distinct(), F.col("item_id").asc(), out="place").select((F.col("place") - 1).alias("place"), "item_id"))


def draw(terms: DataFrame, taken: DataFrame, items: DataFrame, seed: str, reject: Callable[[DataFrame], DataFrame] | None = None, short: str = "raise") -> DataFrame:
    """``term_id, item_id, pick``: the first ``n`` items of each term's own order that are free.

    ``terms`` is ``term_id, n``. An item is free that ``taken`` doesn't pair with the term and that
    ``reject`` doesn't return: it maps pairs ``term_id, item_id`` to those that must not be drawn. Terms
    step on, in rounds of growing length, until they have their items or have seen the whole catalog; then
    too few items are an error, or with ``short="fewer"`` all there are. ``items`` may be ``placed`` already.
    """
    catalog = items if items.columns == ["place", "item_id"] else placed(items)
    n = catalog.count()
    a, b = grid(n)
    size = a * b if n else 0
    asked = terms.where("n > 0").select("term_id", "n", F.lit(0).cast("long").alias("have"), round_keys(seed, F.col("term_id")).alias("keys"))
    # what a term has taken is lost on the way: the first round has so many steps that most terms need no other
    used = taken.join(sorted_join(asked.select("term_id")), "term_id", "left_semi").groupBy("term_id").agg(F.count(F.lit(1)).alias("used"))
    share = F.greatest(F.lit(n) - F.coalesce("used", F.lit(0)), F.lit(1)) / max(n, 1)
    asked = cut(asked.join(sorted_join(used), "term_id", "left").withColumn("to", F.least(F.lit(size), F.ceil((F.col("n") + 4) * 1.25 / share)).cast("long")).withColumn("from", F.lit(0).cast("long")).drop("used"))
    rounds: list[DataFrame] = []
    while True:
        steps = asked.where("from < to").select("term_id", "keys", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("step"))
        met = steps.select("term_id", "step", permuted(F.col("step"), F.col("keys"), n).alias("place")).join(sorted_join(catalog), "place").drop("place")
        free = met.join(sorted_join(taken.select("term_id", "item_id")), ["term_id", "item_id"], "left_anti")
        if reject is not None:
            free = cut(free)
            free = free.join(sorted_join(reject(free.select("term_id", "item_id")).select("term_id", "item_id")), ["term_id", "item_id"], "left_anti")
        rounds.append(cut(free))
        got = rounds[-1].groupBy("term_id").agg(F.count(F.lit(1)).alias("got"))
        left = asked.join(sorted_join(got), "term_id", "left").withColumn("have", F.col("have") + F.coalesce("got", F.lit(0))).where("have < n")
        asked = cut(left.select("term_id", "n", "have", "keys", F.col("to").alias("from"), F.least(F.lit(size).cast("long"), F.col("to") * GROWTH).alias("to")))
        if not asked.where("from < to").limit(1).count():
            break
    if short == "raise" and (row := asked.first()) is not None:
        raise ContractError(f"{asked.count()} terms find too few free items, first {row['term_id']!r}: {row['have']} of {row['n']}")
    found = reduce(lambda x, y: x.unionByName(y), rounds)
    ranked = found.withColumn("pick", F.row_number().over(Window.partitionBy("term_id").orderBy("step")))
    return ranked.join(sorted_join(terms.select("term_id", "n")), "term_id").where("pick <= n").select("term_id", "item_id", "pick")
