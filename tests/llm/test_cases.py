"""Odd inputs of every operator and stage: nulls in any column, repeated rows and ids, ties, empty and
very long texts, empty tables, extra columns with clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from matchrank.llm import exact, infill, licenses, packing, pieces, pii, quality, secret_scan, simhash, token_files, url_lists, word_bpe

tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES, WORDS = (tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
CLASHES = ["_text", "_id", "_pii", "_pii0", "_n", "_parts", "_hits", "_row", "_h", "kind", "score", "cell", "rep", "fp", "bucket", "key", "curve_key", "stretch", "part", "tie", "gone", "component", "content_hash", "sha"]


@pytest.fixture(scope="module")
def messy(spark):
    mail = "write to a.b@c.de about the MIT License and token: abcdefghijklmnop. " * 8
    prose = " ".join(f"word{k % 97} runs{k % 13} over{k % 7}" for k in range(120))
    rows = [
        (1, mail, "en"), (1, mail, "en"), (2, mail, None), (3, prose, "en"), (3, prose + " more", "en"), (4, prose, "de"), (None, prose, "en"), (None, None, None), (None, "short", None),
        (5, None, "en"), (6, "", "en"), (7, " \t\n", "en"), (8, "x" * 150_000, "en"), (9, "a b " * 40_000, "en"), (10, "1.2.3.4 " * 3_000 + "end", "en"),
    ]
    df = spark.createDataFrame([(i, t, lang, "web", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def model(messy):
    return quality.fit(messy, messy.select("doc_id", F.lit(1).alias("quality")))


OPERATORS = {
    "quality": lambda df, m: quality.score(df, m),
    "pieces": lambda df, m: pieces.encode_documents(df, PIECES),
    "token_files": lambda df, m: token_files.read_token_files(token_files.write_token_files(df, BPE)),
    "simhash": lambda df, m: simhash.near_duplicates(df),
    "exact": lambda df, m: exact.mark_duplicates(df),
    "licenses": lambda df, m: licenses.scan(df),
    "secrets": lambda df, m: secret_scan.find_secrets(df),
    "pii": lambda df, m: pii.find_spans(df),
    "infill": lambda df, m: infill.transform(df),
    "word_bpe": lambda df, m: word_bpe.encode_documents(df, WORDS),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_answer_per_row(messy, model, name):
    """Rows that repeat an id or everything, and rows without an id, have an answer each."""
    got = OPERATORS[name](messy, model)
    ids = sorted(-(1 << 63) if r.doc_id is None else r.doc_id for r in got.select("doc_id").collect())
    assert ids == sorted(-(1 << 63) if r.doc_id is None else r.doc_id for r in messy.select("doc_id").collect())
    equal = [tuple(map(str, r)) for r in got.where("doc_id = 1").collect()]
    if name != "token_files":  # there each row has a start of its own
        assert equal[0] == equal[1]
    assert OPERATORS[name](messy.where("false"), model).count() == 0


def test_packing_of_repeats_and_nulls(messy):
    got = packing.pack(messy, BPE).groupBy("doc_id").agg(F.sum("length").alias("n"), F.collect_set("doc_tokens").alias("all"), F.count(F.when(F.col("start") == 0, 1)).alias("docs")).collect()
    docs = {r.doc_id: r.n for r in messy.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.doc_id: r.docs for r in got} == docs
    one = next(r for r in got if r.doc_id == 1)
    assert one.n == 2 * one.all[0]


def test_ties_on_the_curve(spark):
    """Equal texts share a key; their order is by id, and the line has no gap."""
    df = spark.createDataFrame([(k, "same words here") for k in range(50)], "doc_id long, text string").repartition(5)
    rows = sorted(packing.pack(df, BPE, length=16).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert [r.doc_id for r in rows if r.start == 0] == list(range(50))


def test_repeated_captures_keep_their_rows(spark):
    entries = spark.createDataFrame([("a.org", "spam")], "rule string, category string").withColumn("action", F.lit("add")).withColumn("listed_at", F.to_timestamp(F.lit("2024-01-01")))
    seen = [(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/"), (2, None), (None, None), (3, "http://b.org/"), (3, "not a url"), (4, "http://a.org/" + "x/" * 50_000)]
    df = spark.createDataFrame(seen, "page_id long, url string").withColumns({"fetched_at": F.to_timestamp(F.lit("2024-02-01")), "rule": F.lit("clash"), "bucket": F.lit(1), "_id": F.lit(2), "blocked": F.lit(3)})
    got = sorted((r.page_id or 0, r.blocked) for r in url_lists.evaluate(df, url_lists.intervals(entries)).collect())
    assert got == [(0, False), (0, True), (1, True), (1, True), (2, False), (3, False), (3, False), (4, True)]
    assert url_lists.evaluate(df.where("false"), url_lists.intervals(entries)).count() == 0


def test_url_lists_equal_brute_force(spark):
    """Random rules of any depth and case, added and removed, against every rule tried for every capture."""
    import random

    rng = random.Random(11)
    hosts, steps = ["a.com", "x.a.com", "b.org", "c.b.org", "A.com"], ["p", "Q", "r", "s"]
    path = lambda: "".join("/" + rng.choice(steps) for _ in range(rng.randrange(0, 6)))
    log = [(rng.choice(hosts) + path(), rng.choice(["spam", "adult", None]), rng.choice(["add", "add", "remove"]), rng.randrange(0, 90)) for _ in range(300)]
    day = lambda c: F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(days=F.col(c))
    entries = spark.createDataFrame(log, "rule string, category string, action string, d int").withColumn("listed_at", day("d"))
    seen = [(k, f"https://{rng.choice(hosts)}{path()}?q=/p/Q", rng.randrange(0, 120)) for k in range(400)]
    captures = spark.createDataFrame(seen, "page_id long, url string, d int").withColumn("fetched_at", day("d"))
    got = {r.page_id: (r.rule, r.categories) for r in url_lists.evaluate(captures, url_lists.intervals(entries), bucket_days=7).collect()}
    for k, url, d in seen:
        host, _, rest = url[8:].split("?")[0].partition("/")
        own = [x for x in rest.split("/") if x]
        hits = {}
        for rule, category, _, _ in log:
            h, *want = rule.split("/")
            h = h.lower()
            if (host.lower() == h or host.lower().endswith("." + h)) and own[: len(want)] == want:
                at = "/".join([h, *want])
                same = [(x, a == "add") for r, c, a, x in log if "/".join([r.split("/")[0].lower(), *r.split("/")[1:]]) == at and c == category and x <= d]
                if same and max(same)[1]:
                    hits.setdefault(at, set()).add(category or "listed")
        best = min(hits, key=lambda r: (-len(r), r)) if hits else ""
        assert got[k] == (best, ",".join(sorted(set().union(*hits.values())) if hits else [])), (url, d)


def test_redact_keeps_a_column_called_pii(messy):
    out = pii.redact(messy)
    assert out.columns == messy.columns and out.where("_pii <> 'clash _pii' OR _pii0 <> 'clash _pii0'").count() == 0
    text = {r.doc_id: r.text for r in out.where("doc_id > 1").collect()}
    assert text[10] == "[IP] " * 3000 + "end" and text[5] is None and text[6] == "" and text[2].count("[EMAIL]") == 8


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, messy, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    sf = "/root/testdata/sf0.001"
    assert stage(spark, messy.where("false"), sf).count() == 0
    got = stage(spark, messy, sf)
    if name == "packing":
        return
    assert got.columns == messy.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    if name == "personal_data":
        assert len(ids) == messy.count()
    elif name == "exact_dedup":
        assert len(ids) == messy.select(F.coalesce("text", F.lit(""))).distinct().count()
    elif name == "near_dedup":
        assert set(ids) == {None, 1, 3, 5, 8, 9, 10} and ids.count(None) == 3


def test_personal_data_stage_counts_new_characters(spark, messy):
    got = corpus_pipeline.personal_data(spark, messy, "")
    assert got.where("n_chars <> length(text)").count() == 0
