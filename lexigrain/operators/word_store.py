"""Word counts that are kept, and merged with those of new documents without reading old ones again."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions.text import whitespace_tokens
from lexigrain.operators.shared import Folder
from lexigrain.operators.words import word_count

COUNTS = "word string, freq bigint"


class WordStore:
    """Partial counts in a folder, a table for each named set of documents.

    A set counted again takes the place of its earlier table, so a job that is run twice
    counts once.  Names are a caller's: a day, a crawl, a shard.  A small file says which
    tables count; it is replaced as a whole, so a job that breaks off changes nothing.  One
    job writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.folder = Folder(spark, path)
        lists = [n for n in self.folder.names() if re.fullmatch("sets-[0-9]+", n)]
        self.tables: dict[str, str] = self.folder.get(max(lists)) if lists else {}
        self.version = int(max(lists)[5:]) if lists else 0

    def _commit(self, tables: dict[str, str]) -> None:
        self.version += 1
        name = f"sets-{self.version:08d}"
        self.folder.put(name, tables)
        self.tables = tables
        keep = {name, *tables.values()}
        self.folder.drop(*(n for n in self.folder.names() if n not in keep and n.split("-")[0] in ("sets", "counts")))

    def _write(self, counts: DataFrame) -> str:
        name = f"counts-{uuid.uuid4().hex}"
        self.folder.save(counts.select("word", F.col("freq").cast("bigint").alias("freq")), name)
        return name

    def add(self, name: str, docs: DataFrame, text_col: str = "text", tokenizer=whitespace_tokens) -> None:
        """Count docs, and keep the counts as the set name."""
        self.put(name, word_count(docs, text_col, tokenizer))

    def put(self, name: str, counts: DataFrame) -> None:
        self._commit(self.tables | {name: self._write(counts)})

    def sets(self) -> list[str]:
        return sorted(self.tables)

    def remove(self, *names: str) -> None:
        self._commit({k: v for k, v in self.tables.items() if k not in names})

    def counts(self, *names: str) -> DataFrame:
        """(word, freq) of the named sets together, or of all."""
        spark = self.folder.spark
        paths = [f"{self.folder.path}/{self.tables[n]}" for n in (names or self.sets())]
        kept = spark.read.schema(COUNTS).parquet(*paths) if paths else spark.createDataFrame([], COUNTS)
        return kept.groupBy("word").agg(F.sum("freq").alias("freq"))

    def fold(self, into: str, *names: str) -> None:
        """Replace the named sets, or all, by one of their sums."""
        gone = set(names or self.tables)
        made = self._write(self.counts(*gone))
        self._commit({k: v for k, v in self.tables.items() if k not in gone} | {into: made})
