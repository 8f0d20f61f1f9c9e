"""Queries over ranks, decisions, metrics, blends, splits and audits on scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchrank.functions import numeric
from matchrank.operators import blend, decisions, grid, metrics, negatives, ranking, splits
from matchrank.plans.adapters import positives, scored, table, with_

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


S = with_("scored")
RATES = [round(0.15 + 0.005 * k, 3) for k in range(41)]


def _round(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@register(f"{S} SELECT id, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER (), 9) AS rank_pct FROM scored")
def rank_pct_global(spark: SparkSession, sf: str) -> DataFrame:
    return _round(ranking.rank_pct(scored(spark, sf), "score", "rank_pct").select("id", "rank_pct"), "rank_pct")


@register(f"{S} SELECT id, round((rank() OVER (PARTITION BY term_id ORDER BY score) + (count(*) OVER (PARTITION BY term_id, score) - 1) / 2.0) / count(*) OVER (PARTITION BY term_id), 9) AS rank_pct FROM scored")
def rank_pct_group(spark: SparkSession, sf: str) -> DataFrame:
    return _round(ranking.rank_pct(scored(spark, sf), "score", "rank_pct", "term_id").select("id", "rank_pct"), "rank_pct")


@register(f"{S} SELECT id, CAST(row_number() OVER (PARTITION BY term_id ORDER BY score DESC, id) AS INTEGER) AS rank_in_term, count(*) OVER (PARTITION BY term_id) AS term_size FROM scored")
def first_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.first_rank(scored(spark, sf), "term_id", "score", "id").select("id", "rank_in_term", "term_size")


@register(f"{S} SELECT id, row_number() OVER (ORDER BY score DESC, id) AS position FROM scored")
def global_positions(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.positions(scored(spark, sf), "score", "id").select("id", "position")


@register(f"""{S}, r AS (SELECT id, row_number() OVER (ORDER BY score, id) AS r, count(*) OVER () AS n FROM scored)
SELECT id, CAST(greatest(ceil((r - 1) * 7 / greatest(n - 1, 1)::DOUBLE) - 1, 0) AS INTEGER) AS bin FROM r""")
def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.quantile_bins(scored(spark, sf), "score", "id", 7).select("id", "bin")


@register(f"""{S} SELECT count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, min(score) AS lowest, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.25), 6) AS p25,
round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.95), 6) AS p95, max(score) AS highest FROM scored""")
def describe_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _round(ranking.describe(scored(spark, sf), "score"), "mean", "std", "p05", "p25", "p50", "p75", "p95", digits=6)


@register(f"{S} SELECT term_id, count(*) AS n, round(min(score), 9) AS lowest, round(avg(score), 9) AS mean, round(max(score), 9) AS highest, CAST(count(DISTINCT score) AS BIGINT) AS n_scores FROM scored GROUP BY term_id")
def term_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _round(scored(spark, sf).groupBy("term_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"), F.avg("score").alias("mean"), F.max("score").alias("highest"), F.countDistinct("score").alias("n_scores")), "lowest", "mean", "highest")


@register("""WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c, l_tax AS d FROM lineitem)
SELECT 'l_quantity' AS left_name, 'l_extendedprice' AS right_name, round(corr(a, b), 6) AS corr FROM x UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(a, c), 6) FROM x
UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(a, d), 6) FROM x UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(b, c), 6) FROM x
UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(b, d), 6) FROM x UNION ALL SELECT 'l_discount', 'l_tax', round(corr(c, d), 6) FROM x""")
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _round(ranking.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "corr", digits=6)


@register(f"{S} SELECT id, CAST(score >= 10.0 AS INTEGER) AS prediction FROM scored")
def threshold_decision(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.threshold(scored(spark, sf), 10.0).select("id", "prediction")


@register(f"""{S}, b AS (SELECT *, row_number() OVER w AS r, max(score) OVER (PARTITION BY term_id) AS m FROM scored WINDOW w AS (PARTITION BY term_id ORDER BY score DESC, id)),
p AS (SELECT *, CAST(score >= 25.0 OR (r <= 3 AND m >= 12.0) AS INTEGER) AS q FROM b),
c AS (SELECT *, sum(q) OVER (PARTITION BY term_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS nth FROM p)
SELECT id, CAST(q = 1 AND nth <= 12 AS INTEGER) AS prediction FROM c""")
def min_max_per_term(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.threshold_per_term(scored(spark, sf), 25.0, 3, 12, 12.0).select("id", "prediction")


@register(f"{S} SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) <= (SELECT round_even(count(*) * 0.22, 0) FROM scored) AS INTEGER) AS prediction FROM scored")
def rate_decision(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.rate(scored(spark, sf), 0.22).select("id", "prediction")


@register(f"{S} SELECT id, CAST(score >= (SELECT quantile_cont(score, 0.8) FROM scored) AS INTEGER) AS prediction FROM scored")
def rate_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.rate_quantile(scored(spark, sf), 0.2).select("id", "prediction")


_marked = """m AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY score DESC, id) <= greatest(count(*) OVER (PARTITION BY term_id) - {base}, 0) AS mandatory FROM scored)"""


@register(f"""{S}, {_marked.format(base=60)}, p AS (SELECT *, row_number() OVER (PARTITION BY mandatory ORDER BY score DESC, id) AS p FROM m),
b AS (SELECT round_even(count(*) * 0.2, 0) - sum(CAST(mandatory AS INTEGER)) AS more FROM m)
SELECT id, CAST(mandatory OR p <= (SELECT more FROM b) AS INTEGER) AS prediction FROM p""")
def rate_constrained(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.rate_constrained(scored(spark, sf), 0.2, 60).select("id", "prediction")


def _f1(tp: str, fp: str, fn: str, tn: str) -> str:
    half = lambda h: f"(CASE WHEN 2 * {h} + {fp} + {fn} = 0 THEN 0.0 ELSE 2.0 * {h} / (2 * {h} + {fp} + {fn}) END)"
    return f"round(0.5 * ({half(tp)} + {half(tn)}), 9)"


_curve = f"""{S}, {_marked.format(base=60)}, t AS (SELECT count(*) AS n, sum(label) AS pos, sum(CAST(mandatory AS INTEGER)) AS mc, sum(CASE WHEN mandatory THEN label ELSE 0 END) AS mtp FROM m),
o AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS p, sum(label) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS cum FROM m WHERE NOT mandatory),
r AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RATES)}]) AS rate),
a AS (SELECT rate, CAST(round_even(n * rate, 0) AS BIGINT) AS predicted, n, pos, mc, mtp FROM r, t),
b AS (SELECT a.*, mtp + coalesce(cum, 0) AS tp FROM a LEFT JOIN o ON o.p = predicted - mc WHERE predicted >= mc AND predicted <= n),
c AS (SELECT rate, predicted, CAST(tp AS BIGINT) AS tp, {_f1('tp', '(predicted - tp)', '(pos - tp)', '(n - predicted - pos + tp)')} AS macro_f1, CAST(mc AS BIGINT) AS mandatory_count FROM b)"""


@register(f"{_curve} SELECT * FROM c")
def rate_curve_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.rate_curve(scored(spark, sf), RATES, 60), "macro_f1")


@register(f"{_curve} SELECT * FROM c ORDER BY macro_f1 DESC, rate LIMIT 1")
def best_rate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_rate(_round(metrics.rate_curve(scored(spark, sf), RATES, 60), "macro_f1"))


_scan = ", ".join(f"{round(0.5 + 0.5 * k, 9)}::DOUBLE" for k in range(91))


@register(f"""{S}, t AS (SELECT unnest([{_scan}]) AS threshold), a AS (SELECT threshold, sum(CAST(score >= threshold AS BIGINT)) AS predicted, sum(CASE WHEN score >= threshold THEN label ELSE 0 END) AS tp, sum(label) AS pos, count(*) AS n FROM t, scored GROUP BY threshold)
SELECT threshold, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp, {_f1('tp', '(predicted - tp)', '(pos - tp)', '(n - predicted - pos + tp)')} AS macro_f1 FROM a""")
def threshold_scan_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.threshold_scan(scored(spark, sf), 0.5, 45.5, 0.5), "macro_f1")


@register(f"""{S}, a AS (SELECT CAST(sum(CAST(label = 1 AND score >= 20 AS INTEGER)) AS BIGINT) AS tp, CAST(sum(CAST(label = 0 AND score >= 20 AS INTEGER)) AS BIGINT) AS fp, CAST(sum(CAST(label = 1 AND score < 20 AS INTEGER)) AS BIGINT) AS fn,
CAST(sum(CAST(label = 0 AND score < 20 AS INTEGER)) AS BIGINT) AS tn FROM scored) SELECT *, {_f1('tp', 'fp', 'fn', 'tn')} AS macro_f1 FROM a""")
def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.confusion(decisions.threshold(scored(spark, sf), 20.0)), "macro_f1")


@register("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS ratio FROM events GROUP BY event_type")
def source_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.share_by(table(spark, sf, "events"), "event_type"), "ratio")


@register(f"{S} SELECT round(sum(1 - label) / greatest(sum(label), 1), 9) AS pos_weight, round(avg(label), 9) AS positive_rate FROM scored")
def positive_weight(spark: SparkSession, sf: str) -> DataFrame:
    return _round(metrics.pos_weight(scored(spark, sf)), "pos_weight", "positive_rate")


_parts_sql = """a AS (SELECT o_orderkey AS id, o_custkey AS term_id, o_totalprice AS price, CAST(floor(o_totalprice * 7) AS BIGINT) % 1000 / 10.0 AS other, CAST(floor(o_totalprice * 13) AS BIGINT) % 977 / 7.0 AS third, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)"""


def _components(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("term_id"), "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    cut = lambda m, n, d: (F.floor(F.col("o_totalprice") * m) % n) / d
    score = {"price": F.col("o_totalprice"), "other": cut(7, 1000, 10.0), "third": cut(13, 977, 7.0)}
    return {n: o.select("id", "term_id", c.alias("score"), "label") for n, c in score.items()}


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    parts = _components(spark, sf)
    labels = next(iter(parts.values())).select("id", "label")
    return blend.align(parts).join(labels, "id")


@register(f"WITH {_parts_sql} SELECT id, term_id, price, round(other, 6) AS other, round(third, 6) AS third FROM a")
def align_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_aligned(spark, sf).drop("label"), "other", "third", digits=6)


def _pct(c: str, key: str) -> str:
    return f"(rank() OVER (PARTITION BY {key} ORDER BY {c}) + (count(*) OVER (PARTITION BY {key}, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY {key})"


@register(f"""WITH {_parts_sql}, r AS (SELECT id, term_id, {_pct('price', 'term_id')} AS price, {_pct('other', 'term_id')} AS other, {_pct('third', 'term_id')} AS third FROM a),
t AS (SELECT *, round(0.7 * price + 0.3 * other, 9) AS trees FROM r), u AS (SELECT id, term_id, third, {_pct('trees', 'term_id')} AS trees FROM t)
SELECT id, term_id, round(0.5 * trees + 0.5 * third, 9) AS score FROM u""")
def two_level_blend(spark: SparkSession, sf: str) -> DataFrame:
    out = blend.two_level(_aligned(spark, sf), {"price": 0.7, "other": 0.3}, "third").withColumn("score", F.round("score", 9))
    return out.select("id", "term_id", "score")


@register(f"""WITH {_parts_sql}, r AS (SELECT id, term_id, {_pct('price', 'term_id')} AS price, {_pct('other', 'term_id')} AS other, {_pct('third', 'term_id')} AS third FROM a),
s AS (SELECT id, round(0.5 * price + 0.3 * other + 0.2 * third, 9) AS score FROM r)
SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) <= (SELECT round_even(count(*) * 0.26, 0) FROM s) AS INTEGER) AS prediction FROM s""")
def selected_submission(spark: SparkSession, sf: str) -> DataFrame:
    out = blend.ranked(_aligned(spark, sf), ["price", "other", "third"], "term_id")
    out = out.select("id", F.round(blend.weighted({"price": 0.5, "other": 0.3, "third": 0.2}), 9).alias("score"))
    return decisions.rate(out, 0.26)


# fixed values: the grid's step, its rates and its bases (the second is small here, as terms are)
_grid = numeric.simplex_weights(["price", "other", "third"], 0.25)
_grid_rates = [round(0.15 + 0.005 * k, 3) for k in range(41)]
_grid_bases = [0, 14]
_weights_sql = ", ".join(f"({k}, {w['price']}::DOUBLE, {w['other']}::DOUBLE, {w['third']}::DOUBLE)" for k, w in enumerate(_grid))
_grid_sql = f"""WITH {_parts_sql}, r AS (SELECT id, term_id % 5 AS fold, term_id, label, {_pct('price', 'term_id % 5')} AS price, {_pct('other', 'term_id % 5')} AS other, {_pct('third', 'term_id % 5')} AS third FROM a),
l AS (SELECT w.k AS weight_id, id, term_id, label, round(price * w1 + other * w2 + third * w3, 12) AS score FROM r, (VALUES {_weights_sql}) w(k, w1, w2, w3)),
b AS (SELECT unnest({_grid_bases}) AS base),
m AS (SELECT l.*, base, base > 0 AND row_number() OVER (PARTITION BY weight_id, base, term_id ORDER BY score DESC, id) <= greatest(count(*) OVER (PARTITION BY weight_id, base, term_id) - base, 0) AS mandatory FROM l, b),
p AS (SELECT *, row_number() OVER w AS p, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM m WINDOW w AS (PARTITION BY weight_id, base ORDER BY mandatory DESC, score DESC, id)),
t AS (SELECT weight_id, base, count(*) AS n, sum(label) AS pos, sum(CAST(mandatory AS INTEGER)) AS mc FROM m GROUP BY ALL),
g AS (SELECT t.*, rate, CAST(round_even(n * rate, 0) AS BIGINT) AS predicted FROM t, (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in _grid_rates)}]) AS rate)),
x AS (SELECT g.weight_id, g.base, g.rate, {_f1('tp', '(predicted - tp)', '(pos - tp)', '(n - predicted - pos + tp)')} AS macro_f1, CAST(mc AS BIGINT) AS mandatory_count FROM g JOIN p ON p.weight_id = g.weight_id AND p.base = g.base AND p.p = g.predicted WHERE predicted >= mc)"""


def _curve_of_grid(spark: SparkSession, sf: str) -> DataFrame:
    a = _aligned(spark, sf).withColumn("fold", F.col("term_id") % 5)
    return _round(grid.grid_curve(blend.ranked(a, ["price", "other", "third"], "fold"), _grid, _grid_rates, _grid_bases), "macro_f1")


@register(f"{_grid_sql} SELECT * FROM x")
def blend_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _curve_of_grid(spark, sf)


@register(f"{_grid_sql} SELECT * FROM x ORDER BY macro_f1 DESC, weight_id, base, rate LIMIT 1")
def best_blend(spark: SparkSession, sf: str) -> DataFrame:
    return blend.best_point(_curve_of_grid(spark, sf))


_h = "sha256('{seed}' || chr(31) || CAST({c} AS VARCHAR))"
_folds_sql = f"""c AS (SELECT term_id, count(*) AS n_positives, {_h.format(seed='fold', c='term_id')} AS h FROM positives GROUP BY term_id),
b AS (SELECT *, CAST(greatest(ceil((row_number() OVER (ORDER BY n_positives, h) - 1) * 5 / greatest(count(*) OVER () - 1, 1)::DOUBLE) - 1, 0) AS INTEGER) AS bin FROM c),
folds AS (SELECT term_id, n_positives, bin, CAST((row_number() OVER (ORDER BY bin, h) - 1) % 5 AS INTEGER) AS fold FROM b)"""


@register(f"{with_('positives')}, {_folds_sql} SELECT * FROM folds")
def term_folds(spark: SparkSession, sf: str) -> DataFrame:
    return splits.term_folds(positives(spark, sf))


@register(f"{with_('positives')}, {_folds_sql} SELECT term_id, n_positives, CASE WHEN fold = 0 THEN 0 ELSE 1 END AS fold, CASE WHEN fold = 0 THEN 'outer_holdout' ELSE 'outer_train' END AS split FROM folds")
def pilot_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_manifest(positives(spark, sf), "pilot")


@register(f"""{S}, t AS (SELECT DISTINCT term_id FROM scored), r AS (SELECT term_id, row_number() OVER (ORDER BY {_h.format(seed='inner', c='term_id')}, term_id) AS r, count(*) OVER () AS n FROM t)
SELECT id, r <= greatest(round_even(n * 0.1, 0), 1) AS is_valid FROM scored JOIN r USING (term_id)""")
def inner_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.inner_split(scored(spark, sf)).select("id", "is_valid")


@register(f"{S} SELECT id, row_number() OVER (PARTITION BY label ORDER BY {_h.format(seed='rows', c='id')}, id) <= round_even(count(*) OVER (PARTITION BY label) * 0.15, 0) AS is_valid FROM scored")
def stratified_rows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_rows(scored(spark, sf), 0.15, "id").select("id", "is_valid")


@register(f"{S} SELECT id, ('0x' || left({_h.format(seed='rows', c='id')}, 8))::BIGINT / 4294967296.0 < 0.1 AS is_valid FROM scored")
def row_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.row_split(scored(spark, sf), 0.1, "id").select("id", "is_valid")


@register(f"""{S}, q AS (SELECT *, count(*) OVER () AS total, count(*) OVER (PARTITION BY label) AS own, least(round_even(500.0 * sum(label) OVER () / count(*) OVER (), 0), 499) AS pn, row_number() OVER (PARTITION BY label ORDER BY {_h.format(seed='sample', c='id')}, id) AS r FROM scored)
SELECT id, label FROM q WHERE r <= CASE WHEN total <= 500 THEN own WHEN label = 1 THEN pn ELSE 500 - pn END""")
def labelled_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.labelled_sample(scored(spark, sf), 500, "id").select("id", "label")


@register(f"""WITH e AS (SELECT event_id AS id, event_type AS band, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r0, count(*) OVER (PARTITION BY event_type) AS n FROM events),
b AS (SELECT *, CAST(greatest(ceil((r0 - 1) * 4 / greatest(n - 1, 1)::DOUBLE) - 1, 0) AS INTEGER) AS score_bucket FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY band, score_bucket ORDER BY {_h.format(seed='audit', c='id')}, id) AS r FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY r, score_bucket) AS c FROM r WHERE r <= 8) SELECT id, band, score_bucket FROM c WHERE c <= 30""")
def audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("band"), F.col("value").alias("score"))
    return splits.stratified_audit(rows, 30, 4, "band", "score", "id").select("id", "band", "score_bucket")


_bands = {"low": (float("-inf"), 2.0, 300), "mid": (2.0, 4.5, 300), "hard": (4.5, 6.5, 100)}
_band_sql = " UNION ALL ".join(
    f"(SELECT id, '{n}' AS band FROM scored WHERE {'' if lo == float('-inf') else f'score >= {lo} AND '}score < {hi} ORDER BY {_h.format(seed=f'band+{k}', c='id')}, id LIMIT {m})" for k, (n, (lo, hi, m)) in enumerate(_bands.items())
)


@register(f"{S} {_band_sql}")
def score_band_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.score_bands(scored(spark, sf), _bands).select("id", "band")


@register(f"""{S}, q AS (SELECT quantile_cont(score, 0.1) AS q10, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.5) AS q50 FROM scored WHERE label = 1),
l AS (SELECT *, greatest(0.005, 0.6 * q10) AS low FROM q), m AS (SELECT *, greatest(low + 0.01, 0.8 * q25) AS mid FROM l)
SELECT round(q10, 6) AS q10, round(q25, 6) AS q25, round(q50, 6) AS q50, round(low, 6) AS low, round(mid, 6) AS mid, round(greatest(mid + 0.01, 0.9 * q50), 6) AS hard FROM m""")
def calibrated_bands(spark: SparkSession, sf: str) -> DataFrame:
    return _round(negatives.calibrated_bounds(scored(spark, sf).where("label = 1")), "q10", "q25", "q50", "low", "mid", "hard", digits=6)


@register(f"""WITH c AS (SELECT l_orderkey AS term_id, l_partkey AS item_id FROM lineitem), p AS (SELECT l_orderkey AS term_id, l_partkey AS item_id FROM lineitem WHERE l_returnflag = 'R')
SELECT term_id, item_id FROM c EXCEPT SELECT term_id, item_id FROM p""")
def negatives_minus_positives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("term_id"), F.col("l_partkey").alias("item_id"), "l_returnflag")
    return negatives.minus_positives(rows.select("term_id", "item_id"), rows.where("l_returnflag = 'R'"))


@register(f"""WITH p AS (SELECT DISTINCT l_orderkey AS term_id, l_partkey AS item_id FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT DISTINCT l_orderkey AS term_id, l_partkey AS item_id FROM lineitem WHERE l_returnflag <> 'R')
SELECT term_id, item_id, 1 AS label FROM p UNION ALL (SELECT term_id, item_id, 0 FROM n ANTI JOIN p USING (term_id, item_id))""")
def training_frame(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("term_id"), F.col("l_partkey").alias("item_id"), "l_returnflag")
    return negatives.training_frame(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"))


