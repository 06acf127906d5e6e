"""Exact order statistics by group, without sorting a group or holding one in a task.

Approximate quantiles of what is left cut the values of each group into ranges; rows are
counted by range, edges by themselves; only the range that holds the wanted place is looked
at again.  A pass leaves about one in ``EDGES`` of the rows.  When few rows are left they are
counted by value and the place is read off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.operators.shared import Folder

EDGES = 32
#: Rows of a group's range that are counted by value at once.
FEW = 10_000


def select_places(rows: DataFrame, wanted: DataFrame, group: str, value: str, few: int = FEW) -> DataFrame:
    """(group, name, value) for wanted (group, name, place): the value at a place, from 0, of the group's sorted values.

    Nulls in value are not counted; a place beyond the group has no row.
    """
    folder = Folder(rows.sparkSession)
    data = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null")
    ends = data.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    open_ = wanted.select(F.col(group).alias("g"), "name", F.col("place").cast("bigint").alias("place")).join(ends, "g").where("place >= 0 and place < n")
    open_, step, found = folder.save(open_.select("g", "name", "place", "n", "low", "high"), "range-0"), 0, []
    while open_.where((F.col("low") < F.col("high")) & (F.col("n") > few)).head(1):
        found.append(open_.where("low = high"))
        step += 1
        large = open_.where("low < high")
        inside = data.join(large, "g").where(F.col("v").between(F.col("low"), F.col("high")))
        edges = inside.groupBy("g", "name").agg(F.array_distinct(F.percentile_approx("v", [k / EDGES for k in range(1, EDGES)], 2000)).alias("edges"))
        # each edge is a range of its own, so a value that fills a range ends the search
        place_of = lambda v: F.aggregate("edges", F.lit(0), lambda n, e: n + (e < v).cast("int") + (e <= v).cast("int"))
        counts = inside.join(edges, ["g", "name"]).groupBy("g", "name", "place", place_of(F.col("v")).alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        open_ = folder.save(_holding(counts, "part"), f"range-{step}")
    inside = data.join(open_.where("low < high"), "g").where(F.col("v").between(F.col("low"), F.col("high")))
    last = _holding(inside.groupBy("g", "name", "place", "v").agg(F.count("*").alias("n")), "v").select("g", "name", "v")
    for done in [*found, open_.where("low = high")]:
        last = last.unionByName(done.select("g", "name", F.col("low").alias("v")))
    return last.select(F.col("g").alias(group), "name", F.col("v").alias(value))


def _holding(counts: DataFrame, order: str) -> DataFrame:
    """Of the counted ranges of each (g, name), the one that holds place, which then counts from its start."""
    w = Window.partitionBy("g", "name").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return before.where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n"))).withColumn("place", F.col("place") - F.col("before")).drop("before", "part")


def nearest_places(rows: DataFrame, shares: dict[str, float], group: str) -> DataFrame:
    """(group, name, place): index floor(n * share), n - 1 at most, of each group."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.select(group, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("place")) for k, p in shares.items()])).alias("w")).select(group, "w.*")


def as_columns(found: DataFrame, group: str, value: str, names: list[str]) -> DataFrame:
    """One row a group with a column a name."""
    return found.groupBy(group).agg(*[F.max(F.when(F.col("name") == n, F.col(value))).alias(n) for n in names])


def medians(rows: DataFrame, group: str, value: str, few: int = FEW) -> DataFrame:
    """(group, median): the mean of the two middle values."""
    sizes = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    half: Column = (F.col("n") - 1) / 2
    wanted = sizes.select(group, F.explode(F.array(F.struct(F.lit("a").alias("name"), F.floor(half).alias("place")), F.struct(F.lit("b").alias("name"), F.ceil(half).alias("place")))).alias("w")).select(group, "w.*")
    both = as_columns(select_places(rows, wanted, group, value, few), group, value, ["a", "b"])
    return both.select(group, (F.col("a") * 0.5 + F.col("b") * 0.5).alias("median"))
