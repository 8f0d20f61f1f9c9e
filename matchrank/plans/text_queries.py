"""Queries over text functions, features and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchrank.functions import fuzzy, numeric, text
from matchrank.operators import decisions, features
from matchrank.plans import sqltext as q
from matchrank.plans.adapters import SQL, candidate_pairs, items, positives, scored, table, terms, with_
from matchrank.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Add a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@register(f"""SELECT doc_id, md5({q.normalize('text')}) AS folded, md5({q.words('text')}) AS words, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS cleaned FROM documents""")
def normalize_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_text(c)).alias("folded"), F.md5(text.normalize_words(c)).alias("words"), F.md5(text.clean_text(c)).alias("cleaned"))


@register(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all({q.normalize('text')}, '[a-z0-9]+')) AS token FROM documents)
SELECT token, {q.stem('token')} AS stem FROM w""")
def stem_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all(text.normalize_text(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf, "documents").select(F.explode(F.array_distinct(found)).alias("token")).distinct().select("token", text.stem(F.col("token")).alias("stem"))


@register(f"""{with_('terms')} SELECT term_id, array_to_string({q.query_tokens(q.normalize('query'))}, ' ') AS tokens FROM terms""")
def query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return terms(spark, sf).select("term_id", F.array_join(text.query_tokens(text.normalize_text(F.col("query"))), " ").alias("tokens"))


@register(f"""{with_('items')}, p AS (SELECT item_id, {q.parts('category')} AS x FROM items)
SELECT item_id, CASE WHEN length(x) > 0 THEN x[1] ELSE 'unknown' END AS cat_l1,
 CASE WHEN length(x) > 0 THEN array_to_string(x[1:2], '/') ELSE 'unknown' END AS cat_l2,
 CASE WHEN length(x) > 0 THEN array_to_string(x[1:3], '/') ELSE 'unknown' END AS cat_l3,
 CASE WHEN length(x) > 0 THEN x[-1] ELSE 'unknown' END AS cat_leaf FROM p""")
def category_levels(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("item_id", *[c.alias(n) for n, c in text.category_levels(F.col("category")).items()])


@register(f"""{with_('items')} SELECT item_id,
 concat_ws(' ', {q.normalize('title')}, {q.normalize('title')}, {q.normalize('brand')}, {q.normalize('brand')}, {q.normalize('category')}, {q.normalize('attributes')}) AS miner_text,
 concat_ws(' ', {q.words('title')}, {q.words('brand')}, {q.words('category')}, {q.words('attributes')}) AS cache_text,
 concat_ws(' | ', title, category, brand, attributes) AS display_text FROM items""")
def item_texts(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("item_id", text.search_text(text.MINER_WEIGHTS).alias("miner_text"), text.search_text(text.CACHE_WEIGHTS, text.normalize_words).alias("cache_text"), text.display_text().alias("display_text"))


_dims = f"""td AS (SELECT term_id, {q.normalize('query')} AS query, {q.query_tokens(q.normalize('query'))} AS qt FROM terms),
id0 AS (SELECT item_id, {q.normalize('title')} AS title, {q.normalize('category')} AS category, {q.normalize('brand')} AS brand, {q.normalize('attributes')} AS attributes FROM items),
id1 AS (SELECT *, {q.token_set('title')} AS tt, {q.token_set('category')} AS ct, {q.token_set('brand')} AS bt, {q.token_set('attributes')} AS att FROM id0),
idm AS (SELECT *, list_distinct(tt || ct || bt || att) AS ft FROM id1),
f0 AS (SELECT p.id, p.term_id, p.item_id, length(qt)::DOUBLE AS n_query_tokens,
 {q.coverage('qt', 'tt')} AS title_cov, {q.coverage('qt', 'ct')} AS category_cov, {q.coverage('qt', 'bt')} AS brand_cov, {q.coverage('qt', 'att')} AS attr_cov, {q.coverage('qt', 'ft')} AS full_cov,
 CASE WHEN query <> '' AND contains(title, query) THEN 1.0 ELSE 0.0 END::DOUBLE AS query_in_title,
 CASE WHEN query <> '' AND contains(category, query) THEN 1.0 ELSE 0.0 END::DOUBLE AS query_in_category,
 CASE WHEN query <> '' AND contains(brand, query) THEN 1.0 ELSE 0.0 END::DOUBLE AS query_in_brand,
 length(list_filter(qt, lambda t: t IN ({', '.join(f"'{c}'" for c in text.COLORS)}))) AS n_colors,
 length(list_filter(qt, lambda t: t IN ({', '.join(f"'{c}'" for c in text.COLORS)}) AND list_contains(ft, t))) AS n_common,
 brand, length(qt) AS nq, length(tt)::DOUBLE AS title_len, length(ct)::DOUBLE AS category_len, length(bt)::DOUBLE AS brand_len, length(att)::DOUBLE AS attr_len
 FROM pairs p JOIN td USING (term_id) JOIN idm USING (item_id)),
f AS (SELECT *, CASE WHEN full_cov >= 0.999 THEN 1.0 ELSE 0.0 END::DOUBLE AS full_complete, CASE WHEN full_cov >= 0.75 AND full_cov < 0.999 THEN 1.0 ELSE 0.0 END::DOUBLE AS full_high,
 CASE WHEN title_cov >= 0.999 THEN 1.0 ELSE 0.0 END::DOUBLE AS title_complete, CASE WHEN category_cov >= 0.999 THEN 1.0 ELSE 0.0 END::DOUBLE AS category_complete,
 CASE WHEN brand_cov >= 0.999 AND brand <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS brand_complete, CASE WHEN nq <= 2 AND full_cov >= 0.999 THEN 1.0 ELSE 0.0 END::DOUBLE AS short_complete,
 CASE WHEN n_colors > 0 AND n_common = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS color_mismatch, CASE WHEN full_cov < 0.34 THEN 1.0 ELSE 0.0 END::DOUBLE AS weak_match FROM f0)"""
_no_ratio = {k: w for k, w in (features.WEIGHTS | features.BONUSES).items()} | {k: -w for k, w in features.PENALTIES.items() if k not in ("gender_mismatch", "age_mismatch")}
_score_sql = " + ".join(f"{k} * ({w})::DOUBLE" for k, w in _no_ratio.items())
_pairs = with_("items", "terms", "pairs") + ",\n" + _dims
FEATURE_COLUMNS = ["n_query_tokens", "title_cov", "category_cov", "brand_cov", "attr_cov", "full_cov", "query_in_title", "query_in_category", "query_in_brand", "full_complete", "full_high", "title_complete", "category_complete", "brand_complete", "short_complete", "color_mismatch", "weak_match", "title_len", "category_len", "brand_len", "attr_len"]


def _features(spark: SparkSession, sf: str) -> DataFrame:
    joined = features.join_pairs(candidate_pairs(spark, sf), terms(spark, sf), items(spark, sf))
    return features.pair_features(joined, ratios=False)


@register(f"{_pairs} SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURE_COLUMNS)} FROM f")
def lexical_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("id", *[F.round(c, 6).alias(c) for c in FEATURE_COLUMNS])


@register(f"{_pairs} SELECT id, term_id, item_id, round({_score_sql}, 6) AS lexical_score_noratio FROM f")
def lexical_score(spark: SparkSession, sf: str) -> DataFrame:
    out = features.score_pairs(candidate_pairs(spark, sf), terms(spark, sf), items(spark, sf), ratios=False)
    return out.select("id", "term_id", "item_id", F.round("score", 6).alias("lexical_score_noratio"))


@register(f"""{_pairs}, s AS (SELECT id, round({_score_sql}, 6) AS score FROM f), n AS (SELECT CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS n FROM s)
SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) <= (SELECT n FROM n) AS INTEGER) AS prediction FROM s""")
def lexical_rate_decision(spark: SparkSession, sf: str) -> DataFrame:
    out = features.score_pairs(candidate_pairs(spark, sf), terms(spark, sf), items(spark, sf), ratios=False)
    return decisions.rate(out.select("id", F.round("score", 6).alias("score")), 0.2).select("id", "score", "prediction")


@register()
def lexical_score_with_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return features.score_pairs(candidate_pairs(spark, sf), terms(spark, sf), items(spark, sf))


@register()
def fuzzy_ratios(spark: SparkSession, sf: str) -> DataFrame:
    joined = features.join_pairs(candidate_pairs(spark, sf), terms(spark, sf), items(spark, sf))
    ratio = {"ratio": fuzzy.fuzz_ratio, "partial_ratio": fuzzy.fuzz_partial_ratio, "token_set_ratio": fuzzy.fuzz_token_set_ratio, "sequence_ratio": fuzzy.fuzz_sequence_ratio}
    return joined.select("id", *[f("query", "title").alias(n) for n, f in ratio.items()])


@register(f"""{with_('terms', 'items', 'pairs')}, t AS (SELECT term_id, {q.token_set(q.normalize('query'))} AS a FROM terms), i AS (SELECT item_id, {q.token_set(q.normalize('title'))} AS b FROM items)
SELECT id, round(CASE WHEN length(a) + length(b) = 0 THEN 0.0 ELSE 2.0 * length(list_intersect(a, b)) / (length(a) + length(b)) END, 9) AS token_set_similarity,
 round(CASE WHEN length(list_distinct(a || b)) = 0 THEN 1.0 ELSE length(list_intersect(a, b))::DOUBLE / length(list_distinct(a || b)) END, 9) AS jaccard
FROM pairs JOIN t USING (term_id) JOIN i USING (item_id)""")
def token_similarity(spark: SparkSession, sf: str) -> DataFrame:
    t = terms(spark, sf).select("term_id", text.token_set(text.normalize_text(F.col("query"))).alias("a"))
    i = items(spark, sf).select("item_id", text.token_set(text.normalize_text(F.col("title"))).alias("b"))
    joined = candidate_pairs(spark, sf).join(t, "term_id").join(i, "item_id")
    return joined.select("id", F.round(text.token_set_similarity(F.col("a"), F.col("b")), 9).alias("token_set_similarity"), F.round(numeric.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@register("""WITH s AS (SELECT * FROM (VALUES ('tfidf_hard'), ('lexical'), ('embedding'), ('uniform'), ('uniform_backfill_lexical'), ('uniform_backfill_embedding')) v(s))
SELECT event_type || '/' || s AS source, CASE WHEN s IN ('tfidf_hard', 'lexical', 'uniform_backfill_lexical') THEN 'lexical' WHEN s LIKE '%embedding%' THEN 'embedding' ELSE 'uniform' END AS family, count(*) AS n
FROM events, s GROUP BY ALL""")
def source_family(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("tfidf_hard", "lexical", "embedding", "uniform", "uniform_backfill_lexical", "uniform_backfill_embedding")))
    rows = table(spark, sf, "events").select("event_type", F.explode(names).alias("s"))
    return rows.groupBy(F.concat_ws("/", "event_type", "s").alias("source"), text.source_family(F.col("s")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


_us = "chr(31)"


@register(f"""SELECT event_id, sha256('seed' || {_us} || CAST(user_id AS VARCHAR) || {_us} || event_type) AS h FROM events""")
def stable_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", numeric.stable_hash("seed", F.col("user_id").cast("string"), F.col("event_type")).alias("h"))


_blank = " UNION ALL ".join(f"SELECT 'part' AS table_name, '{c}' AS column_name, count(*) AS rows, CAST(coalesce(sum(CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' THEN 1 ELSE 0 END), 0) AS BIGINT) AS blank FROM i" for c in ("item_id", "title", "category", "brand", "gender", "age_group", "attributes"))


@register(f"WITH {SQL['items']}, i AS (SELECT * FROM items) {_blank}")
def blank_audit(spark: SparkSession, sf: str) -> DataFrame:
    return tables.blank_audit(items(spark, sf), "part")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@register(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _TABLES))
def table_audit(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table_audit({t: table(spark, sf, t) for t in _TABLES})


@register(f"{with_('positives')} SELECT term_id, item_id FROM positives")
def positives_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return tables.positive_pairs(positives(spark, sf).withColumn("label", F.lit("1")))


@register(f"{with_('scored')} SELECT id, term_id, round(score, 6) AS score FROM scored")
def score_source(spark: SparkSession, sf: str) -> DataFrame:
    return tables.score_table(scored(spark, sf)).select("id", "term_id", F.round("score", 6).alias("score"))
