"""Analytics over training traces: one long table with a column variant.

Sums are exact decimals, so a result doesn't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions.text import variant_number
from lexigrain.operators import scans, selection

WALL = "decimal(18,6)"


def wall() -> Column:
    """A missing time counts as 0."""
    return F.coalesce(F.col("wall_ms").cast(WALL), F.lit(0).cast(WALL))


def in_steps(trace: DataFrame) -> DataFrame:
    """The trace in blocks of steps: a variant may span many tasks."""
    return scans.blocks(trace, ["variant"], [F.col("step")])


def cumulative(trace: DataFrame, digits: int = 6) -> DataFrame:
    """Seconds so far, by variant."""
    run = scans.running(in_steps(trace), ["variant"], wall(), "total")
    return run.select("variant", "step", F.round(F.col("total").cast("double") / 1000, digits).alias("cum_s"))


def rolling(trace: DataFrame, rows: int = 20, column: str = "wall_ms") -> DataFrame:
    """Mean of the last rows, fewer at the start."""
    made = scans.last_rows(in_steps(trace), ["variant"], rows, total=lambda w: F.sum(F.col(column).cast(WALL)).over(w), times=lambda w: F.count(column).over(w))
    return made.select("variant", "step", F.round(F.col("total").cast("double") / F.nullif("times", F.lit(0)), 6).alias("rolling"))


def rolling_share(trace: DataFrame, share: int = 20) -> DataFrame:
    """rolling() over max(1, rows of the variant // share) rows: running sums that far apart."""
    sizes = trace.groupBy("variant").agg(F.greatest(F.lit(1), F.floor(F.count("*") / share)).alias("n"))
    run = scans.running(in_steps(trace), ["variant"], wall(), "total").withColumnRenamed("__n", "i").join(sizes, "variant")
    earlier = run.select("variant", (F.col("i") + F.col("n")).alias("i"), F.col("total").alias("earlier"))
    out = run.join(earlier, ["variant", "i"], "left")
    return out.select("variant", "step", F.round((F.col("total") - F.coalesce("earlier", F.lit(0).cast(WALL))).cast("double") / F.least("i", "n"), 6).alias("rolling"))


def variant_totals(trace: DataFrame) -> DataFrame:
    return trace.groupBy("variant").agg(F.count("*").alias("steps"), F.sum(wall()).cast("double").alias("total_ms")).withColumn("mean_ms", F.col("total_ms") / F.col("steps"))


def speedups(trace: DataFrame, baseline: str) -> DataFrame:
    """Total time of the baseline over that of each variant, slowest first; empty without the baseline."""
    t = variant_totals(trace)
    base = t.where(F.col("variant") == baseline).select(F.col("total_ms").alias("base_ms"))  # one row
    return t.crossJoin(F.broadcast(base)).select("variant", F.round(F.col("base_ms") / F.nullif("total_ms", F.lit(0.0)), 6).alias("speedup")).orderBy("speedup", "variant")


def percentiles(trace: DataFrame, **shares: float) -> DataFrame:
    """variant and, for each name and share p, the value at index floor(n * p) of the sorted ones, missing ones as 0."""
    timed = trace.select("variant", F.coalesce("wall_ms", F.lit(0.0)).alias("wall_ms"))
    found = selection.select_places(timed, selection.nearest_places(timed, shares, "variant"), "variant", "wall_ms")
    return selection.as_columns(found, "variant", "wall_ms", list(shares))


def nearest(trace: DataFrame, p: float, name: str) -> DataFrame:
    return percentiles(trace, **{name: p})


def summary(trace: DataFrame, baseline: str) -> DataFrame:
    """Steps, total, mean, P50, P95 and speedup (1 without the baseline) by variant."""
    t = variant_totals(trace)
    base = t.agg(F.max(F.when(F.col("variant") == baseline, F.col("total_ms"))).alias("base_ms"))
    out = t.join(percentiles(trace, p50=0.5, p95=0.95), "variant").crossJoin(F.broadcast(base))
    return out.select("variant", "steps", F.round("total_ms", 6).alias("total_ms"), F.round("mean_ms", 6).alias("mean_ms"), "p50", "p95", F.round(F.coalesce(F.col("base_ms") / F.nullif("total_ms", F.lit(0.0)), F.lit(1.0)), 6).alias("speedup"))


def medians(trace: DataFrame) -> DataFrame:
    """The mean of a variant's two middle times; null without a time."""
    middle = selection.medians(trace, "variant", "wall_ms")
    return trace.select("variant").distinct().join(middle, "variant", "left").select("variant", F.round("median", 6).alias("median_ms"))


def step_speedup(pairs: DataFrame) -> DataFrame:
    """t_seq / t_par per step: null where t_par is 0 (speedup), and 0 there (speedup0)."""
    s = F.round(F.col("t_seq") / F.nullif("t_par", F.lit(0.0)), 6)
    return pairs.select("step", s.alias("speedup"), F.coalesce(s, F.lit(0.0)).alias("speedup0"))


def scaling(totals: DataFrame) -> DataFrame:
    """(n, total_ms): time of the smallest n over that of each, and both ideals; empty for one variant."""
    w = Window.orderBy("n")  # a row for each configuration of a family
    out = totals.withColumn("n0", F.first("n").over(w)).withColumn("t0", F.first("total_ms").over(w)).withColumn("k", F.count("*").over(Window.partitionBy(F.lit(1))))
    return out.where("k >= 2").select("n", F.round(F.col("t0") / F.col("total_ms"), 6).alias("speedup"), F.col("n").cast("double").alias("ideal"), F.round(F.col("n") / F.col("n0"), 6).alias("relative_ideal"))


def by_position(trace: DataFrame, variants: list[str], column: str = "wall_ms") -> DataFrame:
    """Variants side by side by row position."""
    placed = scans.numbered(trace, [F.col("step")], "position", ["variant"])
    return placed.groupBy("position").pivot("variant", variants).agg(F.max(column))


def with_extremes(merges: DataFrame, **values: Column) -> DataFrame:
    """merges with aggregates of the whole table as columns, by a broadcast of one row."""
    return merges.crossJoin(F.broadcast(merges.agg(*[v.alias(k) for k, v in values.items()])))


def top_merges(merges: DataFrame, n: int = 30) -> DataFrame:
    """Most frequent merges with merged symbol, its length and percent of the largest."""
    ranked = with_extremes(merges, largest=F.max("freq"))
    return ranked.orderBy(F.desc("freq"), "step").limit(n).select("step", "pair_a", "pair_b", "freq", F.concat("pair_a", "pair_b").alias("merged"), (F.length("pair_a") + F.length("pair_b")).alias("merged_len"), F.round(F.col("freq") * 100.0 / F.greatest(F.coalesce("largest", F.lit(1)), F.lit(1)), 6).alias("percent"))


def first_steps(merges: DataFrame, n: int) -> DataFrame:
    """The first n steps of each variant, or of a single trace."""
    return merges.where(F.col("step") <= n)


def head(trace: DataFrame, k: int = 5) -> DataFrame:
    """The k rows of the smallest steps."""
    return trace.orderBy("step", *[c for c in ("variant",) if c in trace.columns]).limit(k)


def family(trace: DataFrame, prefix: str) -> DataFrame:
    """(n, total_ms) of the variants of a family (`OMP`, `MPI-`) by the number in their names, in its order; 0 without one."""
    mine = trace.where(F.startswith(F.col("variant"), F.lit(prefix)))
    return mine.groupBy(F.coalesce(variant_number(F.col("variant")), F.lit(0)).alias("n")).agg(F.sum(wall()).cast("double").alias("total_ms")).orderBy("n")


def numbered(rows: DataFrame, *order: Column, name: str = "step", parts: int | None = None) -> DataFrame:
    """rows with their place, from 1, in the order."""
    return scans.numbered(rows, order, name, parts=parts)


def bottom_merges(merges: DataFrame, n: int = 10) -> DataFrame:
    return merges.orderBy("freq", "step").limit(n)


def search(merges: DataFrame, query: str, n: int = 100) -> DataFrame:
    """Merges whose symbol contains the query, in any case; a blank one finds all."""
    q = query.strip().lower()
    return merges.where(F.contains(F.lower(F.concat("pair_a", "pair_b")), F.lit(q)) if q else F.lit(True)).orderBy("step").limit(n)


def heatmap_cut(merges: DataFrame, bins: int = 10) -> DataFrame:
    """Mean frequency by right-closed bin of steps and merged length."""
    low, high = F.col("low"), F.col("high")
    b = F.when(high == low, 0).otherwise(F.greatest(F.ceil((F.col("step") - low) * F.lit(float(bins)) / (high - low)) - 1, F.lit(0)))
    return _heatmap(with_extremes(merges, low=F.min("step"), high=F.max("step")).withColumn("bin", b.cast("int")))


def heatmap_floor(merges: DataFrame, bins: int = 10, longest: int = 12) -> DataFrame:
    """Mean frequency by floor bin of steps and merged length up to longest."""
    b = F.least(F.floor((F.col("step") - 1) * F.lit(float(bins)) / F.col("high")), F.lit(bins - 1))
    made = with_extremes(merges, high=F.max("step")).withColumn("bin", b.cast("int"))
    return _heatmap(made.where(F.length("pair_a") + F.length("pair_b") <= longest))


def _heatmap(merges: DataFrame) -> DataFrame:
    return merges.groupBy("bin", (F.length("pair_a") + F.length("pair_b")).alias("merged_len")).agg(F.round(F.avg("freq"), 6).alias("mean_freq"))


def heatmap_grid(cells: DataFrame, lengths: list[int]) -> DataFrame:
    """A heatmap as a grid, empty cells 0."""
    return cells.groupBy("bin").pivot("merged_len", lengths).agg(F.first("mean_freq")).na.fill(0.0)


def tiles(trace: DataFrame, baseline: str) -> DataFrame:
    """Longest variant, number of variants, largest speedup (1 at least) and fastest variant (dash without)."""
    t = trace.groupBy("variant").agg(F.count("*").alias("steps"))
    s = speedups(trace, baseline)
    best = s.where(F.col("speedup") > 1).agg(F.max(F.struct("speedup", "variant")).alias("b"))
    return t.agg(F.coalesce(F.max("steps"), F.lit(0)).alias("total_merges"), F.count("*").alias("variants")).crossJoin(F.broadcast(best)).select("total_merges", "variants", F.coalesce("b.speedup", F.lit(1.0)).alias("max_speedup"), F.coalesce("b.variant", F.lit("-")).alias("fastest"))


def efficiency(log: DataFrame, counts: DataFrame, block: int = 256) -> DataFrame:
    """Report of (t_seq_ms, t_par_ms) steps over a vocabulary: totals, speedup, merges a second, and
    efficiency over one worker a word, words padded to whole blocks."""
    words = counts.agg(F.count("*").alias("unique_words"))
    sums = log.agg(F.count("*").alias("num_merges"), F.coalesce(F.sum(F.col("t_seq_ms").cast(WALL)), F.lit(0)).cast("double").alias("seq"), F.coalesce(F.sum(F.col("t_par_ms").cast(WALL)), F.lit(0)).cast("double").alias("par"))
    sums = sums.crossJoin(F.broadcast(words)).withColumn("threads", F.ceil(F.col("unique_words") / block) * block)  # one row each
    speedup = F.col("seq") / F.nullif("par", F.lit(0.0))
    return sums.select("num_merges", "unique_words", F.col("threads").cast("bigint").alias("threads"), F.round(F.col("seq") / 1000, 6).alias("total_seq_s"), F.round(F.col("par") / 1000, 6).alias("total_par_s"), F.round(speedup, 6).alias("speedup"), F.round(speedup * 100 / F.nullif(F.col("threads").cast("double"), F.lit(0.0)), 6).alias("efficiency_percent"), F.round(F.col("num_merges") * 1000 / F.nullif("seq", F.lit(0.0)), 6).alias("seq_throughput"), F.round(F.col("num_merges") * 1000 / F.nullif("par", F.lit(0.0)), 6).alias("par_throughput"))


def progress(trace: DataFrame, every: int = 100, first: int = 0) -> DataFrame:
    return trace.where((F.col("step") % every == 0) | (F.col("step") <= first))


def union(traces: list[DataFrame]) -> DataFrame:
    """One long table; columns that a trace lacks are null."""
    out = traces[0]
    for t in traces[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def replace_variants(trace: DataFrame, new: DataFrame) -> DataFrame:
    """trace with the variants of new in place of its own of that label."""
    return trace.join(new.select("variant").distinct(), "variant", "left_anti").unionByName(new, allowMissingColumns=True)
