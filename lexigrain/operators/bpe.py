"""Byte pair encoding: training over distinct words, encoding, reports.

Words are counted first, so a step costs distinct words, not the corpus.  A word
is one string with marked symbols (functions.text.wrapped): a merge is a literal
replacement and runs in the scan of the vocabulary, and only the best pair of a
step, one row, comes to the driver.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions.text import CLOSE, END_OF_WORD, OPEN, merged, unwrapped, wrapped
from lexigrain.operators.shared import shared_dir

TRACE = "step int, pair_a string, pair_b string, freq bigint, wall_ms double, vocab_size bigint, avg_tok_len double"
Merge = tuple[str, str]
#: Distinct pairs that a task holds.
HOLD = 500_000


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that all machines share."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(word, freq, s) with s the wrapped symbols."""
    return counts.select("word", "freq", wrapped(F.col("word")).alias("s"))


def pair_counts(vocab: DataFrame) -> DataFrame:
    """(left, right, freq): adjacent pairs weighted by word frequency; a task sends a pair once for each HOLD distinct ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[Merge, int] = defaultdict(int)

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.string()), pa.array([p[1] for p in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["left", "right", "freq"])

        for batch in batches:
            for s, freq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                symbols = s[1:-1].split(CLOSE + OPEN)
                for p in zip(symbols, symbols[1:]):
                    found[p] += freq
            if len(found) > HOLD:
                yield table()
                found.clear()
        if found:
            yield table()

    pairs = vocab.select("s", F.col("freq").cast("bigint").alias("freq")).mapInArrow(count, "left string, right string, freq bigint")
    return pairs.groupBy("left", "right").agg(F.sum("freq").alias("freq"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; ties go to the smaller left, then right."""
    return pairs.orderBy(F.desc("freq"), "left", "right").limit(1)


def merge_pair(vocab: DataFrame, left: str, right: str) -> DataFrame:
    return vocab.withColumn("s", merged(F.col("s"), F.lit(left), F.lit(right)))


def symbol_stats(vocab: DataFrame) -> DataFrame:
    """Distinct symbols in use, and their mean length in bytes over distinct words."""
    used = vocab.select(F.explode(unwrapped(F.col("s"))).alias("symbol")).groupBy("symbol").count()
    return used.agg(F.count("*").alias("vocab_size"), (F.sum(F.octet_length("symbol") * F.col("count")) / F.sum("count")).alias("avg_tok_len"))


def train(counts: DataFrame, merges: int, *, min_freq: int = 2, stats: bool = False, every: int = 10) -> tuple[DataFrame, DataFrame]:
    """(trace, vocabulary after the last merge).

    Stops early when the best pair is rarer than min_freq.  Pairs are counted
    once; a merge then changes the counts by what the words that hold the pair
    lose and gain.  The pair table, and every few merges the vocabulary, are
    checkpointed, which cuts the lineage.
    """
    spark = counts.sparkSession
    shared_checkpoints(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocab, rows = vocabulary(counts).repartition(parts).checkpoint(), []
    pairs = pair_counts(vocab).checkpoint()
    for step in range(1, merges + 1):
        began = time.perf_counter()
        best = best_pair(pairs).first()
        if best is None or best.freq < min_freq:
            break
        rule = F.lit(f"{OPEN}{best.left}{CLOSE}{OPEN}{best.right}{CLOSE}")
        touched = vocab.where(F.contains("s", rule))
        lost = touched.withColumn("freq", -F.col("freq"))
        change = pair_counts(lost.unionByName(merge_pair(touched, best.left, best.right)))
        pairs = pairs.union(change).groupBy("left", "right").agg(F.sum("freq").alias("freq")).where("freq > 0").checkpoint()
        vocab = merge_pair(vocab, best.left, best.right)
        if step % every == 0:
            vocab = vocab.checkpoint()
        used = symbol_stats(vocab).first() if stats else (None, None)
        rows.append((step, best.left, best.right, best.freq, (time.perf_counter() - began) * 1000, *used))
    return spark.createDataFrame(rows, TRACE), vocab


def merges_of(trace: DataFrame) -> list[Merge]:
    """The ordered rules of a trace, the model; one row a merge."""
    return [(r.pair_a, r.pair_b) for r in trace.select("step", "pair_a", "pair_b").orderBy("step").collect()]


def _rules(merges: Sequence[Merge]) -> Column:
    rule = lambda a, b: F.struct(F.lit(f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}").alias("p"), F.lit(f"{OPEN}{a}{b}{CLOSE}").alias("q"))
    return F.array(*[rule(a, b) for a, b in merges])


def encode(word: Column, merges: Sequence[Merge]) -> Column:
    """Symbols of any word by replaying the rules in order."""
    if not merges:
        return unwrapped(wrapped(word))
    return unwrapped(F.aggregate(_rules(merges), wrapped(word), lambda s, m: F.replace(s, m.p, m.q)))


def encode_trace(word: Column, merges: Sequence[Merge]) -> Column:
    """The symbols at the start and after every rule that changed them."""
    start = F.array(wrapped(word))
    if not merges:
        return F.transform(start, unwrapped)

    def step(shots: Column, m: Column) -> Column:
        last = F.element_at(shots, -1)
        return F.when(F.contains(last, m.p), F.concat(shots, F.array(F.replace(last, m.p, m.q)))).otherwise(shots)

    return F.transform(F.aggregate(_rules(merges), start, step), unwrapped)


def without_marker(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != END_OF_WORD)


def encode_distinct(tokens: DataFrame, merges: Sequence[Merge]) -> DataFrame:
    """(word, tokens) with each distinct word encoded once, to be joined back."""
    return tokens.select("word").distinct().withColumn("tokens", encode(F.col("word"), merges))


def encoded_totals(counts: DataFrame, encoded: DataFrame) -> DataFrame:
    """Words, subwords and subwords per word (0 without words) of a corpus by lookup; unknown words have none."""
    joined = counts.join(encoded.select("word", F.size("tokens").alias("n")), "word", "left")
    sums = joined.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.col("freq") * F.coalesce("n", F.lit(0))), F.lit(0)).alias("subwords"))
    return sums.withColumn("subwords_per_word", F.coalesce(F.col("subwords") / F.nullif(F.col("words"), F.lit(0)), F.lit(0.0)))
