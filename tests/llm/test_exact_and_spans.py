import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from matchrank.llm import exact, licenses, pii, secret_scan


def _texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_exact_marks_every_row(docs, empty):
    texts = _texts(docs)
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    got = {r.doc_id: r for r in exact.mark_duplicates(docs, keep="max").collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(groups[t]), len(groups[t]), i == max(groups[t]))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact.mark_duplicates(empty).count() == 0


def test_exact_drop_keeps_columns_and_nulls(docs):
    out = exact.drop_duplicates(docs.unionByName(docs))
    assert out.columns == docs.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert sorted(rows) == [1, 2, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14]
    assert rows[2] is None


def test_collisions_of_the_hash_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(exact, "digests", lambda t: (F.lit(b"same"), F.unhex(F.sha2(t, 256))))
    got = {r.doc_id: r.keep_id for r in exact.mark_duplicates(docs).collect()}
    assert got[5] == got[15] == 5 and got[1] == 1 and got[2] == got[3] == 2


def _luhn(s):
    twice = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(s))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and _luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
}


def test_pii_spans_match_plain_expressions(spark, docs, empty):
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for table in (docs, more):
        got = {r.doc_id: r.s for r in pii.find_spans(table).select("doc_id", pii.listed(F.filter("pii_spans", lambda x: x["kind"] != "iban")).alias("s")).collect()}
        for i, t in _texts(table).items():
            assert got[i] == ",".join(f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, t) if ok(m.group()))
    assert pii.find_spans(empty).count() == 0


def test_pii_iban_and_redaction(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[10] == "mail [EMAIL] or [EMAIL][EMAIL], ip [IP] and 256.1.1.1, card [CARD], [PHONE], [IBAN]"
    assert text[2] is None and text[3] == "" and text[5] == "one two"


def test_running_sum_over_many_blocks(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: (x % 7).cast("int")).alias("v"))
    got = df.select(pii.running_sum(F.col("v")).alias("s")).first().s
    total, want = 0, []
    for x in range(1, 1001):
        total += x % 7
        want.append(total)
    assert got == want


def test_licenses_match_plain_search(docs, empty):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in _texts(docs).items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hits = [(k, lab) for p, lab in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({lab for _, lab in hits})) and 0 <= r.score <= 1
    assert got[12].labels == "apache,cc-by-nc,gpl,mit"
    assert licenses.scan(empty).count() == 0


def test_license_passages_need_their_key_phrase(spark):
    whole = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    rows = [(1, whole), (2, whole.replace("permitted", "allowed")), (3, whole.replace("source", "text")), (4, "the redistribution of use")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd", 2: "bsd", 3: "", 4: ""}


def test_secrets_match_plain_expressions(spark, docs, empty):
    kinds = {
        "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for table in (docs, more):
        got = {r.doc_id: r for r in secret_scan.find_secrets(table).collect()}
        for i, t in _texts(table).items():
            found = sorted((m.start(), k, name, m.end()) for k, (name, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, t) if ok(m))
            want = ",".join(f"{n}:{s}:{e}" for s, _, n, e in found)
            assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert got[i].n_assign == sum(n == "assign" for _, _, n, _ in found)
    assert secret_scan.find_secrets(empty).count() == 0


def test_embedded_checksums():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = f"x ghp_{body}{secret_scan.crc_suffix(body)} y"
    kinds = lambda t: [k for _, _, k in secret_scan.scanner().scan(t)]
    assert "checked" in kinds(good) and "checked" not in kinds(good.replace("a1B2", "a1B3"))


def test_ibans_before_capitals_and_digits(spark):
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    after = ["", " EUR 500", " BIC COBADEFF", " LONDON", " 500", ", x", " DE89 3704 0044 0532 0130 00"]
    rows = [(k, f"{before}{i}{a}") for k, (before, i, a) in enumerate((b, i, a) for b in ("", "to AB12 ") for i in ibans for a in after)]
    want = {k: f"iban:{len(b)}:{len(b) + len(i)}" for k, (b, i, _) in enumerate((b, i, a) for b in ("", "to AB12 ") for i in ibans for a in after)}
    found = F.filter("pii_spans", lambda x: x["kind"] == "iban")
    got = {r.doc_id: r.s for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(found).alias("s")).collect()}
    assert {k: v.split(",")[0] for k, v in got.items()} == want
    wrong = spark.createDataFrame([(1, "DE88370400440532013000 EUR"), (2, "DE8937040044053201300 EUR"), (3, "DE893704004405320130001 EUR")], "doc_id long, text string")
    assert not any(r.pii_spans for r in pii.find_spans(wrong.select("doc_id", F.col("text"))).collect() if any(x.kind == "iban" for x in r.pii_spans))
    assert "[IBAN] EUR 500" in [r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
