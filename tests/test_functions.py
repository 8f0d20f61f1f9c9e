import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchrank.functions import fuzzy, numeric, text


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_normalizers(spark):
    raw = "  ÇİĞ & Işık\t Şöfben-Ürün ß "
    assert _one(spark, raw, text.normalize_text) == "cig isik sofben-urun ss"
    assert _one(spark, raw, text.normalize_words) == "cig isik sofben urun ss"
    assert _one(spark, "IĞDIR İl", text.lower_turkish) == "ığdır il"
    assert _one(spark, None, text.normalize_text) == "" and _one(spark, None, text.clean_text) == ""


def test_stems_and_tokens(spark):
    stems = {"kitaplarin": "kitap", "evden": "ev" + "den", "masalar": "masa", "kutu": "kutu", "arabasi": "araba", "gomlekler": "gomlek"}
    for token, want in stems.items():
        assert _one(spark, token, text.stem) == want
    assert _one(spark, "kirmizi masalar ve set masalar masalar", lambda c: text.query_tokens(c)) == ["kirmizi", "masalar", "masa"]
    assert set(_one(spark, "masalar ve x1", text.token_set)) == {"masalar", "masa", "x1"}
    assert _one(spark, "", text.token_set) == []


def test_coverage_colors_mismatch(spark):
    df = spark.createDataFrame([(["kirmizi", "kadin", "elbise"], ["elbise"], "erkek")], "q array<string>, f array<string>, g string")
    row = df.select(
        text.coverage(F.col("q"), F.col("f")).alias("c"), text.color_tokens(F.col("q")).alias("k"), text.any_mismatch(F.col("q"), F.col("g"), F.col("f"), text.GENDER_ALLOWED).alias("m")
    ).first()
    assert row.c == pytest.approx(1 / 3) and row.k == ["kirmizi"] and row.m == 1.0


def test_categories_and_grams(spark):
    levels = spark.createDataFrame([("Ev / Mutfak//Tabak",), ("",), (None,)], "c string").select(*[c.alias(n) for n, c in text.category_levels(F.col("c")).items()]).collect()
    assert tuple(levels[0]) == ("ev", "ev/mutfak", "ev/mutfak/tabak", "tabak")
    assert tuple(levels[1]) == tuple(levels[2]) == ("unknown",) * 4
    assert _one(spark, "ab c", lambda c: text.char_ngrams(c, 2, 3)) == [" a", "ab", "b ", " ab", "ab ", " c", "c ", " c "]
    assert _one(spark, "x", lambda c: text.char_ngrams(c, 3, 5)) == [" x "]
    assert _one(spark, "a b c", lambda c: text.word_ngrams(F.split(c, " "))) == ["a", "b", "c", "a b", "b c"]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for k, y in enumerate(b, 1):
            prev, row[k] = row[k], prev + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_fuzzy_ratios():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == _lcs(a, b)
    assert fuzzy.indel_ratio("", "") == 100 and fuzzy.indel_ratio("abcd", "abed") == 75
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100
    assert fuzzy.token_set_ratio("red shoe", "shoe red large") == 100 and fuzzy.token_set_ratio("", "a") == 0


def test_numbers(spark):
    assert len(numeric.simplex_weights(["a", "b", "c"], 0.25)) == 15
    assert all(sum(w.values()) == pytest.approx(1) for w in numeric.simplex_weights(["a", "b"], 0.1))
    v = np.arange(1, 5, dtype=float)
    row = spark.createDataFrame([(v.tolist(),)], "v array<double>").select(numeric.dot(numeric.l2_normalize(F.col("v")), numeric.l2_normalize(F.col("v"))).alias("d"), numeric.stable_seed("1", "a").alias("s")).first()
    import hashlib

    assert row.d == pytest.approx(1) and int(row.s) == int.from_bytes(hashlib.sha256(b"1\x1fa").digest()[:8], "little")
    f1 = spark.createDataFrame([(2, 1, 1, 6), (0, 0, 0, 0)], "tp int, fp int, fn int, tn int").select(numeric.macro_f1(*map(F.col, ("tp", "fp", "fn", "tn"))).alias("f")).collect()
    assert f1[0].f == pytest.approx(0.5 * (4 / 6 + 12 / 14)) and f1[1].f == 0
    assert isinstance(pd.Series([1]), pd.Series)


def test_fingerprints_of_rows_and_files(spark, tmp_path):
    from matchrank.functions import numeric

    df = spark.createDataFrame([("x", 1, "é"), ("y", 2, "z")], "b string, a int, c string")
    got = {r.b: r.h for r in df.select("b", numeric.canonical_hash("c", "a", "b").alias("h")).collect()}
    assert got == {b: numeric.canonical_fingerprint({"a": a, "b": b, "c": c}) for b, a, c in df.collect()}
    p = tmp_path / "f"
    p.write_bytes(b"abcdefgh" * 10)
    whole, ends = numeric.file_fingerprint(p, None), numeric.file_fingerprint(p, 8)
    assert whole["size"] == 80 and whole["sha256"] == __import__("hashlib").sha256(p.read_bytes()).hexdigest() != ends["sha256"]
    p.write_bytes(b"abcdefgh" + b"x" * 64 + b"abcdefgh")
    assert numeric.file_fingerprint(p, 8)["sha256"] == ends["sha256"] and numeric.file_fingerprint(p, None)["sha256"] != whole["sha256"]
