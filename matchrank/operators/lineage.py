"""Cutting lineage between stages that refer to each other several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a written table of a few narrow columns is broadcast.
SMALL_ROWS = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. In local mode a temporary folder stands in where
    none is named; on a cluster, which wouldn't share it, that is an error."""
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="matchrank-"))
        found = context.getCheckpointDir()
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sorted_join(df: DataFrame) -> DataFrame:
    """``df`` for joins that must not broadcast it by the planner's estimate. A table that came out of ``explode``
    or of well compressed files is estimated at a small part of its size, and a broadcast goes through the driver."""
    return df.hint("merge")


def small_or_sorted(written: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A written table of a few narrow columns for a join: broadcast up to ``most`` rows, which are counted, else joined by a sort."""
    return F.broadcast(written) if written.limit(most + 1).count() <= most else sorted_join(written)
