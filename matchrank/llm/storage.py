"""Where intermediate tables live: the shared folder that the cluster names.

Lineage is cut by Parquet tables (or ``checkpoint()``) under ``spark.checkpoint.dir``; only in local
mode, where that setting may be absent as in tests, is a folder of our own set. Raw files are
reached through ``pyarrow.fs``, so the folder may be any store with a URI, not just a mounted path.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. In local mode a temporary one is set where none is named; on
    a cluster, whose executors would not share it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='matchrank-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, drop: list[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that no executor loss recomputes it.

    ``drop`` names earlier paths that nothing needs any more once this table is written.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    for old in drop:
        delete(spark, old)
    # shuffle files go when the driver's collector finds them unused, which it may not do for long
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._matchrank_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024, size: int = 1 << 23) -> Iterator[None]:
    """Arrow batches of what is written inside stay below ``rows`` rows and about ``size`` bytes, so
    that two tasks' copies on both sides of the pipe stay small. The session's settings come back after."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def path_of(df: DataFrame) -> str:
    """The path of a table that ``materialize`` returned."""
    return df._matchrank_path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
