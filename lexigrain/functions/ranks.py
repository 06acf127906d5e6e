"""Encoding of words by the ranks of merge rules."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.text import CLOSE, END_OF_WORD, OPEN


class RankEncoder:
    """Applies rules in order, but looks only at those that the word's pairs have.

    The next rule is the lowest one above the last that is among the pairs: what replaying
    all rules does, in steps of the word's own merges.  If a pair is twice among the rules,
    each place counts.
    """

    def __init__(self, merges: Sequence[tuple[str, str]]):
        self.ranks: dict[tuple[str, str], list[int]] = {}
        for rank, pair in enumerate(merges):
            self.ranks.setdefault(tuple(pair), []).append(rank)

    def __call__(self, symbols: list[str]) -> list[str]:
        return self.go_on(symbols, 0)

    def go_on(self, symbols: list[str], first: int, made: Counter | None = None) -> list[str]:
        """symbols after the rules from rank first on; made gets the places merged by each pair."""
        ranks = self.ranks
        while len(symbols) > 1:
            rank, pair = -1, None
            for p in zip(symbols, symbols[1:]):
                if p in ranks:
                    r = next((r for r in ranks[p] if r >= first), -1)
                    if r >= 0 and (pair is None or r < rank):
                        rank, pair = r, p
            if pair is None:
                break
            out, i, n = [], 0, len(symbols)
            left, right = pair
            while i < n:
                if i + 1 < n and symbols[i] == left and symbols[i + 1] == right:
                    out.append(left + right)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            if made is not None:
                made[pair] += n - len(out)
            symbols, first = out, rank + 1
        return symbols


def encode_words(words: DataFrame, merges: Sequence[tuple[str, str]], column: str = "word") -> DataFrame:
    """words with a column tokens, the symbols of each word by the rules; time follows the words, not the rules."""
    encoder = RankEncoder(merges)
    at = words.columns.index(column)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [None if w is None else encoder([*w.replace(OPEN, "").replace(CLOSE, ""), END_OF_WORD]) for w in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.string()))], [*batch.schema.names, "tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(encode, f"{kinds}, tokens array<string>")


def encode_distinct(tokens: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """(word, tokens) with each distinct word encoded once, to be joined back."""
    return encode_words(tokens.select(F.col("word")).distinct(), merges)
