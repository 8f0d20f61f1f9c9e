"""Fill-in-the-middle and word-end BPE against plain Python and the tokenizers library."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchrank.llm import infill, queries, word_bpe

tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def _expected(key, text, unit=infill.LINES, percent=100, spm=50):
    units = re.findall(unit, text)
    h = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k * 8 : k * 8 + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(s in text for s in infill.SENTINELS) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid = "".join(units[:low]), "".join(units[low:high])
    suf = text[len(pre) + len(mid) :]
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if h4 % 100 < spm else "psm", len(pre), len(mid), out


def test_every_form_unit_and_share(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "é", "😀", "\n", "<", "P>", " ", "<S", ">"]) for _ in range(rng.randrange(40))) for _ in range(400)] + ["\n", "x\n", "<P>", "\n" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for unit, percent, spm in ((infill.LINES, 100, 50), (infill.LINES, 30, 0), (r"(?s).", 80, 100), (r"\S+\s*|\s+", 100, 50)):
        got = infill.transform(df, unit=unit, percent=percent, spm_percent=spm).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _expected(r.doc_id, texts[r.doc_id], unit, percent, spm)
            assert r.back == texts[r.doc_id]


def test_registered_infill(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op11_infill(spark, SF).collect():
        n, form, a, b, out = _expected(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, sha(out), sha(texts[r.doc_id]))


def test_no_list_of_units_is_held():
    """The matcher stops at the second rank: an iterator that would fail later isn't read on."""
    text = "ab\n" * 1000

    def lines():
        yield from list(re.finditer(infill.LINES, text))[:7]
        raise AssertionError("read too far")

    assert infill.unit_ends(lines(), 3, 7) == (9, 21) and infill.unit_ends(lines(), 0, 0) == (0, 0)


def test_bad_sentinels_and_units(spark):
    for bad in (("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "><", "<M>")):
        with pytest.raises(ValueError):
            infill.check_sentinels(bad)
    infill.check_sentinels(infill.SENTINELS)
    with pytest.raises(ValueError):
        infill.transform(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), unit="a*")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    return word_bpe.WordBpe(tokenizers.path("word_bpe_49k.json")), lib


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_word_bpe_of_any_text(both, text):
    ours, lib = both
    want = lib.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == want and ours.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_word_bpe_corners(both, monkeypatch):
    ours, lib = both
    texts = ["<|endoftext|>a<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "ΣΑΣ ςσ İıſ", "e\u0301 ﬁ Å", "x\x1cy\x85z\u2028", "it's 'SUPER' they'll", "#" * 100_000, "a" * 50_000, "12345", "", " \n", "\U0001fae8 \U00031350", "中文字 и кириллица"]
    monkeypatch.setattr(word_bpe, "MEMO_WORDS", 2)
    for t in [*texts, *texts]:
        assert ours.encode(t) == lib.encode(t, add_special_tokens=False).ids, t[:20]


def test_registered_word_bpe(spark, both):
    _, lib = both
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op13_word_bpe(spark, SF).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
