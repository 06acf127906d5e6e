"""Helpers shared by the operators: shared-folder tables, worker caches, SQL let."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]+"
#: Spark deletes the shuffle files of a write when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def sql_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; an empty array for null or blank."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS)),
    )


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    return sys.modules.setdefault("_lexigrain_worker", types.ModuleType("_lexigrain_worker")).__dict__


class Scratch:
    """Tables in the folder that the cluster shares, to cut lineage.

    The folder is the session's spark.checkpoint.dir.  Only a local session, as in
    tests, may leave that unset: a temporary folder is made and set.  Tables are
    dropped as soon as nothing reads them, and what is left when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = tempfile.mkdtemp(prefix="lexigrain-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.dir = f"{base.rstrip('/')}/lexigrain-{uuid.uuid4().hex}"
        self._at(self.dir, "mkdirs")
        self._at(self.dir, "deleteOnExit")

    def _at(self, path: str, action: str, *args) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        getattr(path.getFileSystem(self.spark._jsc.hadoopConfiguration()), action)(path, *args)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back; shuffle files of the write go when it ends."""
        path, before = f"{self.dir}/{name}", self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._at(f"{self.dir}/{name}", "delete", True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component) of undirected edges (a, b); component is the smallest node.

    Alternating large-star and small-star rounds: each node links to the
    smallest of its neighbours, so no group is ever gathered in one row and the
    number of rounds is logarithmic.  Nodes without edges don't appear.
    Null ends are ignored.  Each round is a table in the shared folder.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    cur = scratch.save(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}0")
    digest = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen, n = digest(cur), 0
    while seen[0]:
        n += 1
        both = cur.union(cur.select("b", "a")).toDF("u", "v")
        # a table of its own, so that Spark can split the rows of a node with many neighbours
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}{n}-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        nxt = scratch.save(small.select("e.*").where("a <> b").distinct(), f"{tag}{n}")
        scratch.drop(f"{tag}{n - 1}", f"{tag}{n}-low")
        now, cur = digest(nxt), nxt
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b"), F.col("b")).distinct())
