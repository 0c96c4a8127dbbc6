"""A Parquet table whose state is replaced as a whole: each version is a folder, the newest complete one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """Copy-on-write table under ``path``. A version counts once its commit marker is there; old ones stay readable."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in found)

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.path}/v={v[-1]}") if v else None

    def replace(self, df: DataFrame) -> int:
        n = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        return n
