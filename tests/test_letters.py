"""Letters beyond the fold table: by decomposition and by spelling, the rest as before."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from matchrank.functions import text


def _plain(t):
    """NFKD without marks: what the decomposing normalizers do to letters."""
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


@pytest.mark.parametrize(
    ("given", "spelled"),
    [("ﬁne", "fine"), ("①②⑳", "1220"), ("Nike™", "nike(tm)"), ("Привет, Щука", "privet, shchuka"), ("ёж ЙОД", "iozh iod"), ("Αθήνα ψυχή ΧΩΡΑ", "athena psukhe khora"), ("ｆｕｌｌ Ⅷ", "full viii"), ("æther Œuvre", "aether oeuvre"), ("3×4 ½", "3x4 1/2"), ("İSTANBUL ışık", "istanbul isik"), ("plain I", "plain i"), ("", ""), (None, "")],
)
def test_spellings(spark, given, spelled):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(text.normalize_text(F.col("t"))).first()[0] == spelled
    assert df.select(text.normalize_words(F.col("t"))).first()[0] == re.sub("[^a-z0-9]+", " ", spelled).strip()


def test_every_decomposing_letter_of_the_first_plane(spark):
    """Letter by letter, against the decomposition itself."""
    letters = [chr(c) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c) not in text.FOLD_FROM and chr(c) not in text.STROKED and _plain(chr(c)).isascii() and _plain(chr(c)).strip()]
    df = spark.createDataFrame([(k, f"a{c}b") for k, c in enumerate(letters)], "k long, t string")
    for f in (text.normalize_hybrid, text.normalize_vector):
        got = {r.k: r.v for r in df.select("k", f(F.col("t")).alias("v")).collect()}
        for k, c in enumerate(letters):
            assert got[k] == re.sub("[^a-z0-9]+", " ", _plain(f"a{c}b").lower()).strip(), (hex(ord(c)), f.__name__)


def test_other_scripts_stay(spark):
    assert spark.createDataFrame([("中文 ก",)], "t string").select(text.normalize_text(F.col("t"))).first()[0] == "中文 ก"
