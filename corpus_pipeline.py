"""A corpus pipeline of five operators; each stage is written as Parquet and reread by the next.

Part of subpackage ``matchrank.llm``. The stages before the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchrank.llm import exact, packing, pii, quality, simhash
from matchrank.llm.storage import materialize, path_of


# In every stage: a null or empty text counts as a text without words; a null id is an id of its own
# kind, never grouped with others by id; columns may have any further names; an empty table stays empty.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trained forest reject go.

    Null and empty texts fail the base rules and go; rows that repeat are judged each by itself; a text
    of any length is judged whole.
    """
    return quality.keep_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least id stays.

    Null and empty texts are equal; a null id loses to any other; of rows that repeat id and text one stays.
    """
    return exact.drop_duplicates(docs, keep="min")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more of the sets of five-word shingles
    the row with the least id stays.

    Texts without words are one group; rows without an id stay; rows that repeat an id are one
    document, so they stay or go together.
    """
    return simhash.keep_one(docs, words=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the new text.

    All rows stay, a null text stays null with null ``n_chars``; overlapping spans become one.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens along the Hilbert curve.

    Null and empty texts make one id; equal keys follow by id; rows that repeat an id are packed each.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the forest nor the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; a stage's table goes once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}", drop=before)
            before = [path_of(docs)]
    return docs
