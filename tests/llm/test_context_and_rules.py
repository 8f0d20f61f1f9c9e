"""Words around personal data, replacements in bulk, and the many spellings of URL rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from matchrank.llm import pii, queries, url_lists

SF = "/root/testdata/sf0.001"


def _found(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find_spans(df, **how).orderBy("doc_id").collect()
    return [[(s.kind, t[s.s : s.e], round(s.score, 2)) for s in r.pii_spans] for r, t in zip(rows, texts, strict=True)]


def test_context_is_whole_words_of_the_text(spark):
    ssn = lambda text: [m for k, m, _ in text if k == "ssn"]
    a, b, c, d, e = _found(
        spark,
        ["hotel guest ssn 123-45-6789", "ssn for the apartment: 123-45-6789", "SSNs: 123-45-6789, 234-56-7890, 345-67-8901", "recipe 1.2.3.4", "script 1.2.3.4 and ip 5.6.7.8"],
    )
    assert ssn(a) == ssn(b) == ["123-45-6789"] and ssn(c) == ["123-45-6789", "234-56-7890", "345-67-8901"]
    assert d == [("ip", "1.2.3.4", 0.6)] and e == [("ip", "1.2.3.4", 0.8), ("ip", "5.6.7.8", 0.8)]


def test_context_reaches_40_characters(spark):
    for gap, score in ((36, 0.6), (37, 0.4), (38, 0.4)):
        got = _found(spark, ["ssn" + " " * (gap + 1) + "123-45-6789", "x" * 900 + " ssn" + " " * (gap + 1) + "123-45-6789", "123-45-6789" + " " * (gap + 1) + "ssn" + " x" * 30, "123-45-6789" + " " * gap + " ssnx"], least=0)
        assert [g[0][2] for g in got] == [score, score, score, 0.4], gap


def _luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def _iban(m):
    bare = m.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


VALID = {
    "iban": _iban,
    "ssn": lambda m: not re.search("^(?:000|666|9)|-00-|-0000$", m),
    "imei": lambda m: _luhn(re.sub("[^0-9]", "", m)),
}


def _score(kind, text, s, e):
    before, after = text[max(s - 41, 0) : s], text[e : e + 41]
    if s > 40:
        before = re.sub(r"^[^\W_]+", "", before)
    if len(after) > 40:
        after = re.sub(r"[^\W_]+$", "", after)
    near = (before + "\n" + after).lower()
    has = lambda words: re.search(rf"(?<![^\W_])(?:{words})s?(?![^\W_])", near) is not None
    return round(min(1, max(0, kind.prior + (pii.RAISED if has(kind.context) else 0) - (pii.LOWERED if has(kind.against) else 0))), 2)


def test_added_kinds_equal_brute_force_through_the_query(spark):
    """On the table and on texts dense with candidates: spans of iban, ssn and imei with their scores."""
    rng = random.Random(4)
    parts = ["ssn", "SSNs", "part", "apartment", "123-45-6789", "000-11-2222", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "imei", "490154203237518", "49-015420-323751-8", "490154203237519", "phone", "iban", "bank:", "order", "hash", "x" * 30, "\n", "é", "tax id"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(300)] + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kinds = {k.name: k for k in pii.KINDS if k.name in VALID}
    for text, got in zip(texts, _found(spark, texts), strict=True):
        want = []
        for name, kind in kinds.items():
            for m in re.finditer(kind.pattern, text):
                if VALID[name](m[0]) and (score := _score(kind, text, *m.span())) >= pii.LEAST_SCORE:
                    want.append((name, m[0], score))
        assert [g for g in got if g[0] in kinds] == want, text


def test_redaction_of_overlaps_and_of_many_spans(spark):
    """Against the same replacement in plain Python; the array of pieces isn't copied per span."""
    many = "".join(f"u{k}@h.org " for k in range(20_000))
    df = spark.createDataFrame([(1, many), (2, "call +49 4111 1111 1111 1111 now a@1.2.3.4"), (3, ""), (4, None)], "doc_id long, text string")
    spans = {r.doc_id: r.pii_spans for r in pii.find_spans(df).collect()}
    for r, old in zip(pii.redact(df).orderBy("doc_id").collect(), df.orderBy("doc_id").collect(), strict=True):
        if old.text is None:
            assert r.text is None
            continue
        out, at = [], 0
        for s in sorted(spans[r.doc_id], key=lambda s: (s.s, -s.e, s.kind)):
            if s.s >= at:
                out += [old.text[at : s.s], f"[{s.kind.upper()}]"]
            at = max(at, s.e)
        assert r.text == "".join([*out, old.text[at:]])
    assert len(spans[1]) == 20_000


RULES = ["h.com/ads/", "g.com/", "k.com/a//b", "http://m.com/x", "o.com.", " P.com:8080//q ", "//user@r.com./s?x=1#y"]


def _entries(spark, rules):
    return spark.createDataFrame([(r,) for r in rules], "rule string").withColumns({"category": F.lit("spam"), "action": F.lit("add"), "listed_at": F.to_timestamp(F.lit("2024-01-01"))})


def test_rules_block_their_own_urls_however_spelled(spark):
    urls = ["http://h.com/ads", "https://x.g.com/", "http://k.com/a/b/c", "http://m.com//x/", "http://O.com.", "http://p.com/q", "http://a@r.com:1/s/t"]
    seen = spark.createDataFrame(list(enumerate([*urls, "http://h.com/adsx", "http://k.com/a"])), "page_id long, url string").withColumn("fetched_at", F.to_timestamp(F.lit("2024-02-01")))
    got = {r.page_id: r.rule for r in url_lists.evaluate(seen, url_lists.intervals(_entries(spark, RULES))).collect()}
    assert got == dict(enumerate(["h.com/ads", "g.com", "k.com/a/b", "m.com/x", "o.com", "p.com/q", "r.com/s", "", ""]))


def test_rules_without_a_host(spark):
    bad = _entries(spark, ["/only/path", "http://", "...", "ok.org", "/only/path", None])
    assert {(r.rule, r.entries) for r in url_lists.unusable(bad).collect()} == {("/only/path", 2), ("http://", 1), ("...", 1)}
    assert [r.rule for r in url_lists.intervals(bad, strict=False).collect()] == ["ok.org"]
    with pytest.raises(Exception, match="a rule without a host"):
        url_lists.intervals(bad).collect()


def test_the_registered_list_is_spelled_in_every_way(spark):
    name = spark.range(6).select(queries._spelled(F.lit("a.b.c"), "/en", F.col("id")).alias("rule"))
    rules = [r.rule for r in name.collect()]
    assert len(set(rules)) == 6
    assert {r.n for r in name.select(url_lists.normal_rule(F.col("rule")).alias("n")).collect()} == {"a.b.c/en"}
