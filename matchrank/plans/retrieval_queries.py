"""Queries over retrieval, negative mining, slates, category priors and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchrank.functions import text
from matchrank.operators import category, draws, latent, metrics, models, negatives, retrieval, slates, splits
from matchrank.operators.lineage import cut, small_or_sorted, sorted_join
from matchrank.operators.ranking import place
from matchrank.plans import sqltext as q
from matchrank.plans.adapters import items, positives, scored, spread, table, terms, with_
from matchrank.plans.rank_queries import _folds_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _tokens(c: F.Column) -> F.Column:
    return F.regexp_extract_all(text.normalize_words(c), F.lit("[a-z0-9]{2,}"), F.lit(0))


def _grams(c: F.Column) -> F.Column:
    return text.word_ngrams(_tokens(c), 1, 2)


def _chars(c: F.Column) -> F.Column:
    return text.char_ngrams(text.normalize_text(c), 3, 4)


def _grams_sql(x: str) -> tuple[str, str]:
    """The tokens of a text, and the grams of a column ``tk`` of tokens."""
    return f"regexp_extract_all({q.words(x)}, '[a-z0-9]{{2,}}')", "(tk || list_transform(range(1, greatest(length(tk), 1)), lambda k: tk[k] || ' ' || tk[k + 1]))"


def _chars_sql(x: str, low: int, high: int) -> tuple[str, str]:
    """Padded words cut to all lengths; a padded word no longer than n gives itself once."""
    p = "(' ' || w || ' ')"
    per = [f"CASE WHEN length({p}) <= {n} THEN {f'[{p}]' if n == low else f'CASE WHEN length({p}) <= {n - 1} THEN [] ELSE [{p}] END'} ELSE list_transform(range(1, length({p}) - {n} + 2), lambda k: substring({p}, k, {n})) END" for n in range(low, high + 1)]
    return f"list_filter(string_split({q.normalize(x)}, ' '), lambda w: w <> '')", f"flatten(list_transform(tk, lambda w: {' || '.join(f'({c})' for c in per)}))"


def tfidf_sql(name: str, queries: str, catalog: str, features, k: int, min_df: int) -> str:
    """CTEs that end in ``name(query_id, item_id, score, rank)``; sources give (id, text)."""
    f = lambda x: f"{name}_{x}"
    counts = lambda out, key, src: f"{f(out)} AS (SELECT id AS {key}, feature, count(*) AS tf FROM (SELECT id, unnest({features('text')[1]}) AS feature FROM (SELECT id, {features('text')[0]} AS tk FROM ({src}))) GROUP BY ALL)"
    weights = lambda out, src, key: f"{f(out)} AS (SELECT {key}, feature, (1 + ln(tf)) * idf AS w FROM {f(src)} JOIN {f('v')} USING (feature)), {f(out + 'n')} AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {f(out)} GROUP BY {key})"
    return f"""{counts('qc', 'query_id', queries)}, {counts('ic', 'item_id', catalog)},
{f('n')} AS (SELECT (SELECT count(*) FROM ({queries})) + (SELECT count(*) FROM ({catalog})) AS n),
{f('v')} AS (SELECT feature, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT feature, count(*) AS df FROM (SELECT feature FROM {f('qc')} UNION ALL SELECT feature FROM {f('ic')}) GROUP BY feature HAVING count(*) >= {min_df}), {f('n')}),
{weights('q', 'qc', 'query_id')}, {weights('i', 'ic', 'item_id')},
{f('s')} AS (SELECT d.query_id, d.item_id, round(d / (a.norm * b.norm), 9) AS score FROM (SELECT query_id, item_id, sum(x.w * y.w) AS d FROM {f('q')} x JOIN {f('i')} y USING (feature) GROUP BY ALL) d JOIN {f('qn')} a USING (query_id) JOIN {f('in')} b USING (item_id)),
{name} AS (SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM {f('s')} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= {k})"""


@register(f"WITH {tfidf_sql('r', 'SELECT item_id AS id, text FROM benchmark', 'SELECT doc_id AS id, text FROM documents', _grams_sql, 100, 2)} SELECT * FROM r")
def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text"))
    return retrieval.tfidf_top_k(queries, docs, _grams, 100)


_item_text = "SELECT item_id AS id, concat_ws(' ', title, brand, category, attributes) AS text FROM items"
_term_text = "SELECT term_id AS id, query AS text FROM terms"
_lex = tfidf_sql("lex", _term_text, _item_text, _grams_sql, 100, 2)
_emb = tfidf_sql("emb", _term_text, _item_text, lambda x: _chars_sql(x, 3, 4), 100, 2)


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = terms(spark, sf).select(F.col("term_id").alias("query_id"), F.col("query").alias("text"))
    return t, spread(items(spark, sf).select("item_id", F.concat_ws(" ", "title", "brand", "category", "attributes").alias("text")))


def _ranked(q_: DataFrame, i: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The best ``k`` items of each term from vectors of terms and different texts."""
    return cut(retrieval.to_members(retrieval.sparse_top_k(q_, i, k), members, k).withColumnRenamed("query_id", "term_id"))


def _both(spark: SparkSession, sf: str, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """The pools of ``_lexical`` and ``_second``, whose different texts are found once."""
    t, catalog = _sides(spark, sf)
    texts, members = retrieval.distinct_texts(catalog)
    return tuple(_ranked(*retrieval.fit_sides(t, texts, f), members, k) for f in (_grams, _chars))


def _lexical(spark: SparkSession, sf: str, k: int = 100) -> DataFrame:
    return cut(retrieval.tfidf_top_k(*_sides(spark, sf), _grams, k, repeats=True).withColumnRenamed("query_id", "term_id"))


def _second(spark: SparkSession, sf: str, k: int = 100) -> DataFrame:
    return cut(retrieval.tfidf_top_k(*_sides(spark, sf), _chars, k, repeats=True).withColumnRenamed("query_id", "term_id"))


_base = with_("items", "terms", "positives")


@register(f"{with_('items', 'terms')}, {_emb} SELECT query_id AS term_id, item_id, score, rank FROM emb")
def char_ngram_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _second(spark, sf).select("term_id", "item_id", "score", "rank")


@register(f"""{with_('items', 'terms')}, {tfidf_sql('r', _term_text, 'SELECT item_id AS id, title AS text FROM items', _grams_sql, 700, 2)}, h AS (SELECT t.term_id AS query_id, count(r.item_id) AS h FROM terms t LEFT JOIN r ON r.query_id = t.term_id GROUP BY ALL),
f AS (SELECT item_id FROM items ORDER BY item_id LIMIT 700), x AS (SELECT query_id, item_id, h FROM h, f WHERE h < 700 AND NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = h.query_id AND r.item_id = f.item_id))
SELECT query_id, item_id, score, rank FROM r UNION ALL SELECT * FROM (SELECT query_id, item_id, 0.0::DOUBLE AS score, CAST(h + row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS INTEGER) AS rank FROM x) WHERE rank <= 700""")
def zero_padded_topk(spark: SparkSession, sf: str) -> DataFrame:
    t, _ = _sides(spark, sf)
    i = items(spark, sf).select("item_id", F.col("title").alias("text"))
    return retrieval.pad_with_zero_scores(retrieval.tfidf_top_k(t, i, _grams, 700), t, i, 700)


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


_dot = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_dense = f"""d AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, a.label AS ql, b.label AS il, {_dot} AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
k AS (SELECT query_id, item_id, ql, il, round(cosine, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 6) DESC, item_id) AS INTEGER) AS rank FROM d)"""


@register(f"WITH {_dense} SELECT query_id, item_id, score, rank FROM k WHERE rank <= 50")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.dense_top_k(*_vectors(spark, sf), 50, digits=6)


@register(f"""WITH n AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS same, lead(vec_id) OVER (ORDER BY vec_id) AS after FROM embeddings),
p AS (SELECT vec_id AS query_id, same AS item_id FROM n WHERE same IS NOT NULL UNION SELECT vec_id, after FROM n WHERE after IS NOT NULL)
SELECT query_id, item_id, round({_dot}, 6) AS cosine FROM p JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = item_id""")
def pair_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with the next one of its label and with the next one of all."""
    e = table(spark, sf, "embeddings")
    same = e.select(F.col("vec_id").alias("query_id"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("item_id")).where("item_id IS NOT NULL")
    placed = place(e.select("vec_id"), F.col("vec_id").asc(), out="p")
    after = placed.select(F.col("vec_id").alias("query_id"), (F.col("p") + 1).alias("p")).join(placed.select(F.col("vec_id").alias("item_id"), "p"), "p").drop("p")
    v = e.select("vec_id", F.col("embedding").alias("vector"))
    pairs = same.unionByName(after).distinct()
    return retrieval.pair_cosine(pairs, v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "item_id")).select("query_id", "item_id", F.round("cosine", 6).alias("cosine"))


@register(f"""WITH {_dense}, p AS (SELECT * FROM k WHERE ql = il), ks AS (SELECT unnest([10, 20, 50]) AS k)
SELECT ks.k, CAST(sum(CAST(p.rank <= ks.k AS INTEGER)) AS BIGINT) AS hits, count(*) AS positives, round(sum(CAST(p.rank <= ks.k AS INTEGER)) / greatest(count(*), 1), 9) AS recall FROM p, ks GROUP BY ks.k""")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    pos = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("term_id"), "label").join(e.select(F.col("vec_id").alias("item_id"), "label"), "label").drop("label")
    top = retrieval.dense_top_k(*_vectors(spark, sf), 50, digits=6).withColumnRenamed("query_id", "term_id")
    out = metrics.recall_at(top, pos, "rank", [10, 20, 50])
    return out.withColumn("recall", F.round("recall", 9))


_facts = f"facts AS (SELECT item_id, title, brand, {q.token_set(q.words('title'))} AS tokens FROM items)"


def _item_facts(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("item_id", "title", "brand", text.token_set(text.normalize_words(F.col("title"))).alias("tokens"))


def _dups(cand: str) -> str:
    return f"""SELECT DISTINCT c.term_id, c.item_id FROM {cand} c JOIN positives p ON p.term_id = c.term_id JOIN facts x ON x.item_id = c.item_id JOIN facts y ON y.item_id = p.item_id
WHERE c.item_id = p.item_id OR (x.title = y.title AND x.brand = y.brand) OR CASE WHEN length(list_distinct(x.tokens || y.tokens)) = 0 THEN 1.0 ELSE length(list_intersect(x.tokens, y.tokens))::DOUBLE / length(list_distinct(x.tokens || y.tokens)) END >= 0.9"""


@register(f"{_base}, {_lex}, {_facts}, c AS (SELECT query_id AS term_id, item_id FROM lex) {_dups('c')}")
def near_duplicate_filter(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.near_duplicates_of_positives(_lexical(spark, sf), positives(spark, sf), _item_facts(spark, sf))


def _sha(*parts: str) -> str:
    return "sha256(" + " || chr(31) || ".join(parts) + ")"


def uniform_sql(name: str, taken: str, n: int, seed: str, asked: str = "", near: bool = False, steps: int | None = None) -> str:
    """CTEs that end in ``name(term_id, item_id, pick)``; ``asked`` gives (term_id, want) where not all
    terms of ``taken`` want ``n``. ``near`` leaves out near copies of positives. Each term's permutation is
    followed for ``steps`` steps."""
    key = lambda k: f"(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT % {draws.SPAN})"

    def mixed(x: str, k: int) -> str:
        y = f"(({x} * {draws.MIX_1} + {key(k)}) % {draws.SPAN})"
        z = f"((xor({y}, {y} >> {draws.SHIFT_1}) * {draws.MIX_2}) % {draws.SPAN})"
        return f"xor({z}, {z} >> {draws.SHIFT_2})"

    rounds = [f"{name}_{k + 1} AS (SELECT * REPLACE ({f'(l + {mixed("r", k)}) % a AS l' if k % 2 == 0 else f'(r + {mixed("l", k)}) % b AS r'}) FROM {name}_{k})" for k in range(draws.ROUNDS)]
    return f"""{name}_c AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM (SELECT DISTINCT item_id FROM items)),
{name}_z AS (SELECT a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM {name}_c)),
{name}_t AS (SELECT term_id, want, {_sha(repr(seed), 'term_id')} AS h FROM ({asked or f"SELECT DISTINCT term_id, {n} AS want FROM {taken}"})),
{name}_s AS (SELECT *, unnest(range(0, {f'least(a * b, {steps})' if steps else 'a * b'})) AS step FROM {name}_t, {name}_z),
{name}_0 AS (SELECT *, step // b AS l, step % b AS r FROM {name}_s), {", ".join(rounds)},
{name}_m AS (SELECT term_id, want, step, item_id FROM {name}_{draws.ROUNDS} x JOIN {name}_c c ON c.place = x.l * x.b + x.r ANTI JOIN {taken} USING (term_id, item_id)),
{name}_p AS (SELECT term_id, want, item_id, row_number() OVER (PARTITION BY term_id ORDER BY step) AS pick FROM {name}_m {f"ANTI JOIN ({_dups(f'{name}_m')}) USING (term_id, item_id)" if near else ""}),
{name} AS (SELECT term_id, item_id, pick FROM {name}_p WHERE pick <= want)"""


@register(f"{_base}, {_facts}, {uniform_sql('u', 'positives', 20, 'uniform', near=True, steps=400)} SELECT term_id, item_id, CAST(pick AS INTEGER) AS pick FROM u")
def uniform_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Each term's own draws from the catalog, none a positive or a near copy of one."""
    p, facts = positives(spark, sf), _item_facts(spark, sf)
    return negatives.uniform(p, facts, 20, "uniform", negatives.NearCopies(p, facts))


@register(f"""{_base}, {_lex}, free AS (SELECT query_id AS term_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM lex l WHERE NOT EXISTS (SELECT 1 FROM positives x WHERE x.term_id = l.query_id AND x.item_id = l.item_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY {_sha("'tfidf'", 'term_id', 'item_id')}, item_id) AS r FROM free WHERE p > 25),
taken AS (SELECT query_id AS term_id, item_id FROM lex UNION SELECT term_id, item_id FROM positives WHERE term_id IN (SELECT query_id FROM lex)), {uniform_sql('u', 'taken', 10, 'tfidf-easy', steps=400)}
SELECT term_id, item_id, 'hard' AS negative_band, score AS tfidf_score FROM free WHERE p <= 25 UNION ALL SELECT term_id, item_id, 'mid', score FROM m WHERE r <= 15 UNION ALL SELECT term_id, item_id, 'easy', 0.0 FROM u""")
def tfidf_band_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.tfidf_bands(_lexical(spark, sf), positives(spark, sf), items(spark, sf))


def _band_sql(family: str, pool: str, before: str, n: int) -> str:
    free = f"{family}_f AS (SELECT query_id AS term_id, item_id, score, rank FROM {pool} l WHERE NOT EXISTS (SELECT 1 FROM positives x WHERE x.term_id = l.query_id AND x.item_id = l.item_id)), {family}_d AS ({_dups(family + '_f')})"
    rows = f"{family}_r AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY {_sha(repr('mine-' + family), 'term_id', 'item_id')}, item_id) AS r FROM {family}_f ANTI JOIN {family}_d USING (term_id, item_id) {f'ANTI JOIN {before} USING (term_id, item_id)' if before else ''} WHERE rank BETWEEN 21 AND 60)"
    kept = f"{family}_k AS (SELECT term_id, item_id, '{family}' AS negative_source, rank AS source_rank, score AS source_score FROM {family}_r WHERE r <= {n})"
    so_far = f"{family}_o AS (SELECT * FROM {family}_k {f'UNION ALL SELECT * FROM {before}' if before else ''})"
    gap = f"{family}_g AS (SELECT t.term_id, {n} - count(k.item_id) AS gap FROM (SELECT DISTINCT term_id FROM positives) t LEFT JOIN {family}_k k USING (term_id) GROUP BY t.term_id HAVING count(k.item_id) < {n})"
    taken = f"{family}_t AS (SELECT term_id, item_id FROM positives UNION SELECT term_id, item_id FROM {family}_o)"
    fill = uniform_sql(f"{family}_u", f"{family}_t", n, f"mine-fill-{family}", f"SELECT term_id, gap AS want FROM {family}_g", near=True, steps=400)
    done = f"{family} AS (SELECT * FROM {family}_o UNION ALL SELECT term_id, item_id, 'uniform_backfill_{family}', 0, 0.0 FROM {family}_u)"
    return ", ".join((free, rows, kept, so_far, gap, taken, fill, done))


@register(f"{_base}, {_lex}, {_emb}, {_facts}, {uniform_sql('u0', 'positives', 5, 'mine-uniform', near=True, steps=400)}, u1 AS (SELECT term_id, item_id, 'uniform' AS negative_source, 0 AS source_rank, 0.0::DOUBLE AS source_score FROM u0), {_band_sql('lexical', 'lex', 'u1', 10)}, {_band_sql('embedding', 'emb', 'lexical', 10)} SELECT * FROM embedding")
def rank_band_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.rank_band_negatives(*_both(spark, sf), positives(spark, sf), _item_facts(spark, sf), 21, 60, 10, uniform_rows=5)


@register()
def tfidf_band_negatives_300(spark: SparkSession, sf: str) -> DataFrame:
    """N5 at its whole size: bands over the first 300 rows of each term."""
    return negatives.tfidf_bands(_lexical(spark, sf, 300), positives(spark, sf), items(spark, sf))


@register()
def contrastive_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """N7's contrastive recipe: 10 rows of each family from ranks 101 to 500."""
    return negatives.rank_band_negatives(*_both(spark, sf, 500), positives(spark, sf), _item_facts(spark, sf), 101, 500, 10)


@register()
def reranker_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """N7's reranker recipe: 20 uniform rows, then 15 of each family from ranks 21 to 200."""
    return negatives.rank_band_negatives(*_both(spark, sf, 500), positives(spark, sf), _item_facts(spark, sf), 21, 200, 15, uniform_rows=20)


_slate_rows = """x AS (SELECT coalesce(l.query_id, p.term_id) AS term_id, coalesce(l.item_id, p.item_id) AS item_id, CAST(p.term_id IS NOT NULL AS INTEGER) AS label, coalesce(l.rank, 0) AS retrieval_rank, coalesce(l.score, 0.0) AS retrieval_score, CAST(l.rank IS NOT NULL AS INTEGER) AS is_retrieved FROM lex l FULL JOIN positives p ON p.term_id = l.query_id AND p.item_id = l.item_id)
SELECT 'OOF_' || lpad(CAST(row_number() OVER (ORDER BY term_id, 1 - is_retrieved, retrieval_rank, item_id) - 1 AS VARCHAR), 10, '0') AS slate_id, term_id, item_id, fold, label, count(*) OVER (PARTITION BY term_id) AS candidate_count, is_retrieved, retrieval_rank, retrieval_score FROM x JOIN folds USING (term_id)"""
_slate = f"{_base}, {_lex}, {_folds_sql}, {_slate_rows}"


@register(_slate)
def lexical_slate(spark: SparkSession, sf: str) -> DataFrame:
    p = positives(spark, sf)
    return slates.lexical_slate(_lexical(spark, sf), p, splits.term_folds(p))


@register(f"""{_base}, {_lex}, {_emb}, {_folds_sql}, found AS (SELECT coalesce(l.term_id, e.term_id) AS term_id, coalesce(l.item_id, e.item_id) AS item_id, lr, ls, er FROM (SELECT query_id AS term_id, item_id, rank AS lr, score AS ls FROM lex WHERE rank <= 40) l FULL JOIN (SELECT query_id AS term_id, item_id, rank AS er FROM emb WHERE rank <= 40) e ON e.term_id = l.term_id AND e.item_id = l.item_id),
taken AS (SELECT term_id, item_id FROM found UNION SELECT term_id, item_id FROM positives), {uniform_sql('u', 'taken', 20, 'slate', steps=600)},
alls AS (SELECT term_id, item_id FROM found UNION SELECT term_id, item_id FROM positives UNION SELECT term_id, item_id FROM u),
y AS (SELECT a.term_id, a.item_id, CAST(p.item_id IS NOT NULL AS INTEGER) AS label, lr, ls, er, u.pick, round(coalesce(m.score, 0.0), 9) AS semantic_cosine FROM alls a LEFT JOIN found f ON f.term_id = a.term_id AND f.item_id = a.item_id LEFT JOIN u ON u.term_id = a.term_id AND u.item_id = a.item_id LEFT JOIN positives p ON p.term_id = a.term_id AND p.item_id = a.item_id LEFT JOIN emb_s m ON m.query_id = a.term_id AND m.item_id = a.item_id),
z AS (SELECT *, CASE WHEN lr IS NOT NULL THEN 0 WHEN er IS NOT NULL THEN 1 WHEN pick IS NOT NULL THEN 2 ELSE 3 END AS a, coalesce(lr, er, pick, 0) AS b FROM y)
SELECT 'HYBRID_' || lpad(CAST(row_number() OVER (ORDER BY term_id, a, b, item_id) - 1 AS VARCHAR), 10, '0') AS slate_id, term_id, item_id, fold, label, count(*) OVER (PARTITION BY term_id) AS candidate_count, CAST(lr IS NOT NULL OR er IS NOT NULL AS INTEGER) AS is_retrieved, coalesce(lr, 0) AS retrieval_rank, coalesce(ls, 0.0) AS retrieval_score,
CASE WHEN a = 3 THEN 'positive_union' ELSE concat_ws('+', CASE WHEN lr IS NOT NULL THEN 'tfidf' END, CASE WHEN er IS NOT NULL THEN 'embedding' END, CASE WHEN pick IS NOT NULL THEN 'uniform' END) END AS candidate_sources, semantic_cosine,
round((rank() OVER (PARTITION BY term_id ORDER BY semantic_cosine) + (count(*) OVER (PARTITION BY term_id, semantic_cosine) - 1) / 2.0) / count(*) OVER (PARTITION BY term_id), 9) AS semantic_rank_pct FROM z JOIN folds USING (term_id)""")
def hybrid_slate(spark: SparkSession, sf: str) -> DataFrame:
    p, (t, catalog) = positives(spark, sf), _sides(spark, sf)
    texts, members = retrieval.distinct_texts(catalog)
    q, i = retrieval.fit_sides(t, texts, _chars)
    lexical, second = _ranked(*retrieval.fit_sides(t, texts, _grams), members, 100), _ranked(q, i, members, 100)
    cosine = lambda pairs: retrieval.member_similarity(pairs, q, i, members)
    out = slates.hybrid_slate(lexical, second, p, items(spark, sf), splits.term_folds(p), cosine)
    return out.withColumn("semantic_rank_pct", F.round("semantic_rank_pct", 9))


def _spaces(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Terms and different texts in the items' n-gram space (long form, of texts what terms ask for), which text an item has, and
    terms and texts encoded by the truncated SVD of that space; texts count as often as items have them, and those without features have no vector."""
    t, catalog = _sides(spark, sf)
    texts, members = retrieval.distinct_texts(catalog)
    q_, i = retrieval.fit_sides(t, texts, _grams, every=True)
    rows = cut(retrieval.gathered_vectors({"x": i}, "item_id").join(sorted_join(texts.select("item_id", "n")), "item_id"))
    encoder = latent.fit_rows(rows)
    asked = small_or_sorted(cut(q_.select("fid").distinct()))
    return q_, i.join(asked, "fid", "left_semi"), members, cut(encoder.encode(q_, "query_id")), cut(encoder.encode_rows(rows, "item_id"))


def _latent(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Terms and items encoded by ``_spaces``."""
    _, _, members, terms_, texts = _spaces(spark, sf)
    return terms_, members.join(sorted_join(texts.withColumnRenamed("item_id", "first")), "first").select("item_id", "vector")


def _nearest(terms_: DataFrame, texts: DataFrame, members: DataFrame) -> DataFrame:
    return retrieval.to_members(retrieval.dense_top_k(terms_, texts, 100), members, 100)


@register()
def latent_topk(spark: SparkSession, sf: str) -> DataFrame:
    """T10, T12 with an encoder that learns: the first 100 items of each term by cosine in its latent space."""
    _, _, members, terms_, texts = _spaces(spark, sf)
    return _nearest(terms_, texts, members)


@register()
def hybrid_slate_dense(spark: SparkSession, sf: str) -> DataFrame:
    """L2 with a dense pool of its own: lexical rows, the latent space's nearest, uniform rows, positives, and
    the latent cosine of every candidate."""
    p, (q_, i, members, terms_, texts) = positives(spark, sf), _spaces(spark, sf)
    pool = cut(_nearest(terms_, texts, members).withColumnRenamed("query_id", "term_id"))
    under = lambda pairs: retrieval.pair_cosine(pairs, terms_, texts).select("query_id", "item_id", F.col("cosine").alias("similarity"))
    cosine = lambda pairs: retrieval.by_members(pairs, members, under)
    return slates.hybrid_slate(_ranked(q_, i, members, 100), pool, p, items(spark, sf), splits.term_folds(p), cosine)


@register()
def latent_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many of each term's first 10 items of the sparse space are among the first 10, 50 and 100 of the latent one."""
    q_, i, members, terms_, texts = _spaces(spark, sf)
    wanted = _ranked(q_, i, members, 10).select("term_id", "item_id")
    pool = _nearest(terms_, texts, members).withColumnRenamed("query_id", "term_id")
    return metrics.recall_at(pool, wanted, "rank", [10, 50, 100])


_examples = f"""ex AS (SELECT DISTINCT {q.normalize('query')} AS query_norm, {q.normalize("split_part(category, '/', 1)")} AS cat_l1, {q.normalize('category')} AS cat_l2 FROM positives JOIN terms USING (term_id) JOIN items USING (item_id))"""


@register(f"""{_base}, {_examples}, t AS (SELECT DISTINCT cat_l2, query_norm, unnest(list_distinct({q.raw_tokens('query_norm')})) AS token FROM ex), s AS (SELECT token, cat_l2 AS label, count(*) AS n FROM t GROUP BY ALL), g AS (SELECT token, label, n::DOUBLE / sum(n) OVER (PARTITION BY token) AS p FROM s),
a AS (SELECT term_id, unnest(list_distinct({q.raw_tokens(q.normalize('query'))})) AS token FROM terms), k AS (SELECT term_id, count(*) AS t FROM a WHERE token IN (SELECT token FROM g) GROUP BY term_id),
x AS (SELECT term_id, label, round(sum(p) / max(k.t), 9) AS prob FROM a JOIN g USING (token) JOIN k USING (term_id) GROUP BY ALL)
SELECT term_id, label, prob, CAST(row_number() OVER (PARTITION BY term_id ORDER BY prob DESC, label) AS INTEGER) AS rank FROM x QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY prob DESC, label) <= 5""")
def category_prior_topk(spark: SparkSession, sf: str) -> DataFrame:
    ex = category.category_examples(positives(spark, sf), terms(spark, sf), items(spark, sf))
    asked = terms(spark, sf).withColumn("query_norm", text.normalize_text(F.col("query")))
    return category.count_prior(ex, asked, "cat_l2", text.raw_tokens(F.col("query_norm")))


@register(f"""{_base}, {_examples}, c AS (SELECT cat_l2, count(*) AS n FROM ex GROUP BY cat_l2), k AS (SELECT cat_l2 FROM c WHERE n >= 10 UNION ALL (SELECT cat_l2 FROM c WHERE (SELECT max(n) FROM c) < 10 ORDER BY n DESC, cat_l2 LIMIT 1)) SELECT query_norm, cat_l1, cat_l2 FROM ex WHERE cat_l2 IN (SELECT cat_l2 FROM k)""")
def class_filtered_examples(spark: SparkSession, sf: str) -> DataFrame:
    ex = category.category_examples(positives(spark, sf), terms(spark, sf), items(spark, sf))
    return category.class_filter(ex, "cat_l2", 10).select("query_norm", "cat_l1", "cat_l2")


@register()
def category_prior_logistic(spark: SparkSession, sf: str) -> DataFrame:
    """Both category levels, at the operator's own sizes."""
    ex = category.category_examples(positives(spark, sf), terms(spark, sf), items(spark, sf))
    asked = terms(spark, sf).withColumn("query_norm", text.normalize_text(F.col("query")))
    first, second = (category.logistic_prior(ex, asked, level).withColumn("level", F.lit(level)) for level in category.LEVELS)
    return first.unionByName(second)


def _event_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).withColumn("hour", F.col("id") % 24).withColumn("kind", (F.col("term_id") % 7).cast("string"))
    return rows.withColumn("fold", (F.col("term_id") % 3).cast("int"))


@register()
def gbt_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = models.out_of_fold(_event_rows(spark, sf), 3, ["score", "hour"], ["kind"])
    return out.select("id", "fold", "prob")


@register()
def pair_head_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    pairs = _labelled_pairs(e)
    return models.predict_pair_head(models.train_pair_head(pairs), pairs).select("a", "b", "label", "prob")


@register()
def pair_head_perceptron(spark: SparkSession, sf: str) -> DataFrame:
    """G9 with a hidden layer."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    pairs = _labelled_pairs(e)
    return models.predict_pair_head(models.train_pair_head(pairs, hidden=16), pairs).select("a", "b", "label", "prob")


def _labelled_pairs(e: DataFrame) -> DataFrame:
    """Each vector with the next one of its label and the next one by id."""
    nxt = e.select(F.col("vec_id").alias("b"), F.col("v").alias("i"))
    same = e.withColumn("b", F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))).select(F.col("vec_id").alias("a"), F.col("v").alias("q"), "b", F.lit(1).alias("label"))
    near = e.select(F.col("vec_id").alias("a"), F.col("v").alias("q"), (F.col("vec_id") + 1).alias("b"), F.lit(0).alias("label"))
    return same.unionByName(near).where("b IS NOT NULL").join(nxt, "b")


@register(f"""{_base}, b AS (SELECT row_number() OVER (ORDER BY term_id, item_id) - 1 AS row_index, term_id, item_id FROM (SELECT term_id, min(item_id) AS item_id FROM positives GROUP BY term_id)), c AS (SELECT DISTINCT row_index // 64 AS batch, item_id FROM b)
SELECT row_index, c.item_id, c.item_id <> b.item_id AND EXISTS (SELECT 1 FROM positives p WHERE p.term_id = b.term_id AND p.item_id = c.item_id) AS masked FROM b JOIN c ON c.batch = b.row_index // 64""")
def known_positive_mask(spark: SparkSession, sf: str) -> DataFrame:
    p = positives(spark, sf)
    firsts = p.groupBy("term_id").agg(F.min("item_id").alias("item_id"))
    b = place(firsts, F.col("term_id").asc(), F.col("item_id").asc(), out="row_index").withColumn("row_index", F.col("row_index") - 1).withColumn("batch", F.floor(F.col("row_index") / 64))
    return negatives.known_positive_mask(b, b, p)
