"""The driver's tables in the roles of the engine's inputs, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan of fewer splits than there are slots, dealt over all of them; larger ones stay as they are."""
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots) if scan.rdd.getNumPartitions() < slots else scan


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as the catalog."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("title"),
        F.concat_ws("/", "p_type", "p_brand").alias("category"),
        F.col("p_brand").alias("brand"),
        F.lit("").alias("gender"),
        F.lit("").alias("age_group"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("attributes"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-case name and type; the text is its own id."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select(text.alias("term_id")).distinct().withColumn("query", F.col("term_id"))


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with the term made of its own name and type."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select(text.alias("term_id"), F.col("p_partkey").cast("string").alias("item_id")).distinct()


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and items that share the first word."""
    t = terms(spark, sf_dir).select("term_id", F.split_part("query", F.lit(" "), F.lit(1)).alias("w"))
    i = items(spark, sf_dir).select("item_id", F.split_part(F.lower("title"), F.lit(" "), F.lit(1)).alias("w"))
    # pairs made from two small tables come out of few tasks: they are dealt out like a table of their own
    return t.join(i, "w").select(F.concat_ws("#", "term_id", "item_id").alias("id"), "term_id", "item_id").repartition("id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as scored, labelled pairs."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("term_id"), F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label")
    )


SQL = {
    "items": "items AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, p_type || '/' || p_brand AS category, p_brand AS brand, '' AS gender, '' AS age_group, 'size ' || CAST(p_size AS VARCHAR) AS attributes FROM part)",
    "terms": "terms AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS term_id, lower(p_name || ' ' || p_type) AS query FROM part)",
    "positives": "positives AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS term_id, CAST(p_partkey AS VARCHAR) AS item_id FROM part)",
    "pairs": "pairs AS (SELECT t.term_id || '#' || i.item_id AS id, t.term_id, i.item_id FROM terms t JOIN items i ON split_part(t.query, ' ', 1) = split_part(lower(i.title), ' ', 1))",
    "scored": "scored AS (SELECT event_id AS id, user_id AS term_id, value AS score, CAST(event_type = 'purchase' AS INTEGER) AS label FROM events)",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
