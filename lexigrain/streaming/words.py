"""Incremental word count over Structured Streaming: as a running table, or into counts that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from lexigrain.functions.text import whitespace_tokens
from lexigrain.operators.word_store import WordStore
from lexigrain.operators.words import word_count


def running_word_count(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq) of all text so far, for complete or update mode; state is one row a word."""
    return word_count(stream, text_col)


def kept_word_count(stream: DataFrame, path: str, text_col: str = "text", tokenizer=whitespace_tokens, *, fold: int = 50) -> DataStreamWriter:
    """A writer that adds each batch's counts to the WordStore at path; no word is state of the stream.

    A batch is a set of its number, so one that runs again after a failure counts once.
    When more than ``fold`` sets are there, those of earlier batches become one; the batch
    at hand stays apart, as it may still run again.
    """

    def add(batch: DataFrame, number: int) -> None:
        store = WordStore(batch.sparkSession, path)
        store.add(f"batch-{number:012d}", batch, text_col, tokenizer)
        if len(store.sets()) > fold:
            store.fold(f"upto-{number - 1:012d}", *(n for n in store.sets() if n != f"batch-{number:012d}"))

    return stream.writeStream.foreachBatch(add)
