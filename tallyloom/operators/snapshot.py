"""Versions of an engine: state tables and fitted pipelines that belong together.

A version is written in full, then named in the commits; what isn't named there does not exist for readers, so a version
appears at once or not at all, and a reader keeps the version it opened.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not base.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(base):
            return []
        return [r[0] for r in self.spark.read.schema("version int").json(f"{self.path}/commits").orderBy("version").collect()]  # a row a version

    def publish(self, tables: dict[str, DataFrame], pipelines: dict[str, PipelineModel]) -> int:
        version = max(self.versions(), default=0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/version={version}/tables/{name}")
        for name, model in pipelines.items():
            model.write().overwrite().save(f"{self.path}/version={version}/pipelines/{name}")
        self.spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return version

    def _version(self, version: int | None) -> int:
        have = self.versions()
        if not have or version is not None and version not in have:
            raise FileNotFoundError(f"no such version in {self.path}")
        return have[-1] if version is None else version

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={self._version(version)}/tables/{name}")

    def pipeline(self, name: str, version: int | None = None) -> PipelineModel:
        return PipelineModel.load(f"{self.path}/version={self._version(version)}/pipelines/{name}")
