"""Running totals and windows over groups that span many tasks.

Rows are dealt by range of (group, order) and sorted, so a group is a stretch of
consecutive blocks.  A block's place and sum follow from those before it, one row a block
and group; a window over the last rows also gets the halo that it needs: rows of the blocks
before that lie within reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.operators.shared import Folder, shuffle_partitions

_BLOCK, _AT, _N = "__block", "__at", "__n"


def blocks(rows: DataFrame, group: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """rows by range of group and order, saved, with block, place in it and, as __n, the place in the group from 1."""
    spark = rows.sparkSession
    folder = Folder(spark)
    parts = parts or shuffle_partitions(spark)
    by = [*map(F.col, group), *order]
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({_BLOCK: F.spark_partition_id(), _AT: F.monotonically_increasing_id()})
    placed = folder.save(placed, "blocks")
    starts = before(placed.groupBy(*group, _BLOCK).agg(F.count("*").alias("n"), F.min(_AT).alias("low")), group, "n")
    joined = _on(placed, starts.select(*group, _BLOCK, "before", "low"), [*group, _BLOCK])
    return joined.withColumn(_N, F.col("before") + F.col(_AT) - F.col("low") + 1).drop("before", "low")


def before(sums: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """sums, a row a block and group, with the sum of value over the group's earlier blocks."""
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join that takes null keys as equal; left's columns, then what right has besides."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, same).drop(*(f"__{k}" for k in keys))


def plain(rows: DataFrame) -> DataFrame:
    return rows.drop(_BLOCK, _AT, _N)


def numbered(rows: DataFrame, order: Sequence[Column], name: str, group: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """rows with their place, from 1, in the order, within their group."""
    return plain(blocks(rows, group, order, parts).withColumn(name, F.col(_N)))


def running(placed: DataFrame, group: Sequence[str], value: Column, name: str) -> DataFrame:
    """placed, from blocks(), with the sum of value over the group's rows up to each."""
    kept = placed.withColumn("__v", value)
    offsets = before(kept.groupBy(*group, _BLOCK).agg(F.sum("__v").alias("sum")), group, "sum").select(*group, _BLOCK, "before")
    inside = F.sum("__v").over(Window.partitionBy(*group, _BLOCK).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0))
    return _on(kept.withColumn("__s", inside), offsets, [*group, _BLOCK]).withColumn(name, F.col("before") + F.col("__s")).drop("__v", "__s", "before")


def last_rows(placed: DataFrame, group: Sequence[str], rows: int, **made) -> DataFrame:
    """placed, from blocks(), with columns made over a window of the last so many rows of the group.

    A value of made gets the window and gives the column.
    """
    ends = placed.groupBy(*group, _BLOCK).agg(F.min(_N).alias("first"), F.max(_N).alias("end"))
    # every block has a row, so no more than rows - 1 blocks are within reach
    following = Window.partitionBy(*(group or [F.lit(1)])).orderBy(_BLOCK).rowsBetween(1, max(rows - 1, 1))
    ends = ends.withColumn("next", F.collect_list(F.struct(F.col(_BLOCK).alias("block"), "first")).over(following)).drop("first")
    tails = _on(placed, ends, [*group, _BLOCK]).where(F.col(_N) > F.col("end") - (rows - 1))
    reached = F.filter("next", lambda b: b.first < F.col(_N) + rows)
    halo = tails.withColumn("to", F.explode(reached)).withColumn(_BLOCK, F.col("to.block")).drop("to", "next", "end").withColumn("__own", F.lit(False))
    both = placed.withColumn("__own", F.lit(True)).unionByName(halo)
    w = Window.partitionBy(*group, _BLOCK).orderBy(_N).rowsBetween(1 - rows, 0)
    return both.withColumns({k: f(w) for k, f in made.items()}).where("__own").drop("__own")
