"""The registered queries over whole tables, one per operator, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchrank.llm import exact, infill, lexical, licenses, packing, pieces, pii, quality, secret_scan, simhash, token_files, url_lists, word_bpe


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_docs(spark, sf_dir), _vocabulary("piece_bpe_32k.model"), with_ids=False)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(_docs(spark, sf_dir), _vocabulary("byte_bpe_50k.json")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir), words=4)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_duplicates(_docs(spark, sf_dir), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _spelled(name: F.Column, path: str, code: F.Column) -> F.Column:
    """One of the ways to write a rule."""
    ways = ("{n}{p}", "http://{n}{p}/", "{n}.{p}", "//{n}:8080/{p}//", " {N}/{p}", "https://user@{N}.{p}?q=1#top")
    put = lambda way: F.replace(F.replace(F.replace(F.lit(way), F.lit("{n}"), name), F.lit("{N}"), F.upper(name)), F.lit("{p}"), F.lit(path))
    return F.get(F.array(*map(put, ways)), F.pmod(code, F.lit(len(ways))))


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of ``pages`` (fetched on a day that follows from the id) against a dated list over
    all their hosts: of each host's registered name, an entry is added on one day, removed on a
    later one and, for some, added again; path rules cover the language folders of some hosts. The
    list spells its rules in many ways: with scheme, port, capitals, final dot, empty steps."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    later = lambda days: start + F.make_interval(days=days.cast("int"))
    captures = pages.withColumn("fetched_at", later(F.col("page_id") * 37 % 365))
    name = F.regexp_extract(url_lists.host(F.col("url")), r"([^.]+\.[^.]+\.[^.]+)$", 1)
    names = pages.select(name.alias("name")).where("name <> ''").distinct()
    code = F.length("name") * 31 + F.ascii("name") * 7
    log = names.select("name", code.alias("code")).select(
        F.explode(
            F.array(
                *[
                    F.when(when, F.struct(_spelled(F.col("name"), path, F.col("code") + k).alias("rule"), F.lit(category).alias("category"), F.lit(action).alias("action"), later(day).alias("listed_at")))
                    for k, (when, path, category, action, day) in enumerate((
                        (F.col("code") % 3 < 2, "", "spam", "add", F.col("code") % 200),
                        (F.col("code") % 3 < 2, "", "spam", "remove", F.col("code") % 200 + 60),
                        (F.col("code") % 3 == 0, "", "spam", "add", F.col("code") % 200 + 120),
                        (F.col("code") % 4 == 1, "/en", "adult", "add", F.col("code") % 100),
                    ))
                ]
            )
        ).alias("e")
    )
    entries = log.where("e IS NOT NULL").select("e.*")
    found = url_lists.evaluate(captures, url_lists.intervals(entries))
    return found.select("page_id", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "blocked", "rule", "categories")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir)).drop("places")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_docs(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii_spans")
    count = lambda name: F.size(F.filter("pii_spans", lambda x: x["kind"] == name)).cast("long")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("pii_spans")).alias("spans"),
        F.array_join(F.transform("pii_spans", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(_docs(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    asked = items.select(F.explode(lexical.terms(F.col("text"))).alias("term"))
    return lexical.search(lexical.build(_docs(spark, sf_dir), asked=asked), items, 20)


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_documents(_docs(spark, sf_dir), _vocabulary("word_bpe_49k.json"), with_ids=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP6_SQL = r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
             regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^?#]*)', 1) AS path, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS d FROM pages),
n AS (SELECT *, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS name FROM p),
names AS (SELECT DISTINCT name, length(name) * 31 + ascii(name) * 7 AS code FROM n WHERE name <> ''),
e AS (SELECT name, name AS rule, 'spam' AS category, TRUE AS listed, code % 200 AS day FROM names WHERE code % 3 < 2
  UNION ALL SELECT name, name, 'spam', FALSE, code % 200 + 60 FROM names WHERE code % 3 < 2
  UNION ALL SELECT name, name, 'spam', TRUE, code % 200 + 120 FROM names WHERE code % 3 = 0
  UNION ALL SELECT name, name || '/en', 'adult', TRUE, code % 100 FROM names WHERE code % 4 = 1),
h AS (SELECT n.page_id, e.rule, e.category, arg_max(listed, day) AS listed FROM n JOIN e ON e.name = n.name AND DATE '2024-01-01' + CAST(day AS INTEGER) <= n.d AND (e.rule = n.name OR split_part(path, '/', 1) = 'en') GROUP BY ALL),
b AS (SELECT page_id, list(rule ORDER BY length(rule) DESC, rule)[1] AS rule, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM h WHERE listed GROUP BY page_id)
SELECT n.page_id, strftime(d, '%Y-%m-%d') AS fetched_on, b.page_id IS NOT NULL AS blocked, coalesce(rule, '') AS rule, coalesce(categories, '') AS categories FROM n LEFT JOIN b ON b.page_id = n.page_id
"""

OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 25, 8))::BIGINT AS h4, string_split(text, chr(10)) AS lines FROM t),
c AS (SELECT *, len(lines) - CAST(lines[-1] = '' AS BIGINT) AS n FROM k),
r AS (SELECT *, h1 % (n + 1) AS r1, h2 % (n + 1) AS r2 FROM c),
e AS (SELECT *, [least(length(text), coalesce(list_sum(list_transform(lines[1:u], lambda x: length(x) + 1)), 0)) FOR u IN [least(r1, r2), greatest(r1, r2)]] AS ends,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, CAST(ends[1] AS BIGINT) AS a, CAST(ends[2] AS BIGINT) AS b FROM e),
x AS (SELECT *, '<P>' || substring(text, 1, a) AS pre, '<S>' || substring(text, b + 1) AS suf, '<M>' || substring(text, a + 1, b - a) AS mid FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM x
"""

_terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_terms}) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_terms}) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (doc_id), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 20
"""

QUERIES = {f.__name__: f for f in (op1_quality, op2_sentencepiece, op3_token_files, op4_simhash, op5_exact_dedup, op6_url_lists, op7_licenses, op8_secrets, op9_packing, op10_pii, op11_infill, op12_lexical_search, op13_word_bpe, pipeline)}
ORACLES = {"op5_exact_dedup": OP5_SQL, "op6_url_lists": OP6_SQL, "op11_infill": OP11_SQL, "op12_lexical_search": OP12_SQL}
