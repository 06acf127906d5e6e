"""Word counts and corpus statistics."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.text import djb2, ratio, whitespace_tokens


#: Bytes of a scan up to which its rows are dealt to all cores.
SMALL = 256 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows of a small scan dealt to all cores: a file of one row group is one task, however long its texts take.

    Larger inputs have as many row groups as there is work, and are not shuffled.
    """
    if rows.isStreaming:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if size <= SMALL else rows


def tokens(docs: DataFrame, text_col: str = "text", tokenizer=whitespace_tokens, *keys: str) -> DataFrame:
    """One row a token: keys and word."""
    return spread(docs.select(*dict.fromkeys([*keys, text_col]))).select(*keys, F.explode(tokenizer(F.col(text_col))).alias("word"))


def word_count(docs: DataFrame, text_col: str = "text", tokenizer=whitespace_tokens, *keys: str) -> DataFrame:
    """(keys, word, freq): partial counts before the one shuffle."""
    return tokens(docs, text_col, tokenizer, *keys).groupBy(*keys, "word").agg(F.count("*").alias("freq"))


def top_words(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("freq"), "word").limit(n)


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total_tokens"), F.count("*").alias("unique_tokens"))


def throughput(counts: DataFrame, seconds: float) -> DataFrame:
    return totals(counts).withColumn("tokens_per_second", ratio(F.col("total_tokens"), F.lit(seconds)))


def measured_throughput(docs: DataFrame, text_col: str = "text", tokenizer=whitespace_tokens) -> DataFrame:
    """totals() with the seconds that counting took, reading included, and tokens a second."""
    began = time.perf_counter()
    found = totals(word_count(docs, text_col, tokenizer)).first()
    made = docs.sparkSession.createDataFrame([(*found, time.perf_counter() - began)], "total_tokens bigint, unique_tokens bigint, seconds double")
    return made.withColumn("tokens_per_second", ratio(F.col("total_tokens"), F.col("seconds")))


def corpus_stats(docs: DataFrame, text_col: str = "text", *keys: str) -> DataFrame:
    """Documents, characters, tokens, distinct words and distinct characters, by keys."""
    size = docs.groupBy(*keys).agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"))
    words = word_count(docs, text_col, whitespace_tokens, *keys).groupBy(*keys).agg(F.sum("freq").alias("tokens"), F.count("*").alias("unique_words"))
    chars = docs.select(*keys, F.explode(F.array_distinct(F.split(text_col, ""))).alias("c")).where("c <> ''").distinct().groupBy(*keys).agg(F.count("*").alias("unique_chars"))
    zero = lambda df: df.select("documents", "chars", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "unique_words", "unique_chars")], *keys)
    if not keys:
        return zero(size.join(words).join(chars))  # three single rows
    return zero(size.join(words, list(keys), "left").join(chars, list(keys), "left"))


def bucket_health(counts: DataFrame, buckets: int = 100_003) -> DataFrame:
    """Load factor, longest chain and empty buckets of a djb2 hash table of the words."""
    chains = counts.groupBy(djb2(F.col("word"), buckets).alias("bucket")).agg(F.count("*").alias("chain"))
    out = chains.agg(F.coalesce(F.sum("chain"), F.lit(0)).alias("words"), F.coalesce(F.max("chain"), F.lit(0)).alias("max_chain"), (F.lit(buckets) - F.count("*")).alias("empty_buckets"))
    return out.select("words", "max_chain", "empty_buckets", (F.col("words") / F.lit(float(buckets))).alias("load_factor"), (F.col("empty_buckets") * 100.0 / buckets).alias("empty_percent"))


def lookup(words: DataFrame, vocabulary: DataFrame, value: str, missing: Column) -> DataFrame:
    """words left-joined with a vocabulary on word; missing where there is none."""
    return words.join(vocabulary.select("word", value), "word", "left").withColumn(value, F.coalesce(F.col(value), missing))
