"""Tables and small files in the folder that the cluster shares."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may leave it unset and gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="lexigrain-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Folder:
    """Tables below a folder; one without a name is new and goes when the session ends."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/lexigrain-{uuid.uuid4().hex}"
        if not path:
            self._do("", "mkdirs")
            self._do("", "deleteOnExit")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _do(self, name: str, action: str, *args):
        at = self._at(name)
        return getattr(at.getFileSystem(self.spark._jsc.hadoopConfiguration()), action)(at, *args)

    def save(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Write df, partitioned by columns, in place of what is there, and read it back."""
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._do(name, "delete", True)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._do("", "listStatus")) if self._do("", "exists") else []

    def put(self, name: str, value) -> None:
        """A small JSON file, which is there as a whole or not at all."""
        out = self._do(f"{name}.tmp", "create", True)
        out.write(json.dumps(value).encode())
        out.close()
        self._do(f"{name}.tmp", "rename", self._at(name))

    def get(self, name: str):
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value)
