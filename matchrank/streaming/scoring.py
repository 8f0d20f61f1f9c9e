"""The stateless score path over arriving candidate pairs: stream-static joins, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from matchrank.operators.features import score_pairs
from matchrank.sources.tables import PAIRS


def pair_stream(spark, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Candidate pairs from CSV files as they arrive."""
    return spark.readStream.schema(PAIRS).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def score_stream(pairs: DataFrame, terms: DataFrame, items: DataFrame, out: str, checkpoint: str, ratios: bool = False) -> StreamingQuery:
    """Append scores of each micro-batch to Parquet; the checkpoint makes restarts exact."""
    scored = score_pairs(pairs, terms, items, ratios)
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
