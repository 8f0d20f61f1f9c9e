"""Stage caches on Parquet with a manifest: reuse when the configuration agrees, refuse when not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchrank.functions.numeric import canonical_fingerprint
from matchrank.sources.contracts import ContractError


class StageCache:
    """Named stages under one folder. A stage is valid if its manifest row names this configuration;
    the row is written after the data, so an interrupted stage is built again."""

    def __init__(self, spark: SparkSession, folder: str, config: dict, overwrite: bool = False):
        self._spark, self._folder, self._overwrite = spark, folder.rstrip("/"), overwrite
        self.fingerprint = canonical_fingerprint(config)

    def _manifest(self, stage: str) -> str | None:
        try:
            return self._spark.read.schema("stage string, fingerprint string").json(f"{self._folder}/{stage}.manifest").first()["fingerprint"]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def get(self, stage: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, built and written if it isn't there."""
        found = self._manifest(stage)
        if found not in (None, self.fingerprint) and not self._overwrite:
            raise ContractError(f"{stage} was built for another configuration")
        if found != self.fingerprint:
            build().write.mode("overwrite").parquet(f"{self._folder}/{stage}")
            self._spark.createDataFrame([(stage, self.fingerprint)], "stage string, fingerprint string").write.mode("overwrite").json(f"{self._folder}/{stage}.manifest")
        return self._spark.read.parquet(f"{self._folder}/{stage}")
