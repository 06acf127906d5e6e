"""Training by scans: the vocabulary as blocks of symbol numbers, merged as arrays.

While pairs stand in a large part of all words, an index of them saves nothing.  A block is
the symbols of many words one after another, GAP behind each word, and the words'
frequencies.  A merge is a few comparisons over the block, and counts of pairs change by
what the words it touched lose and gain.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.text import CLOSE, END_OF_WORD, OPEN

#: A character's number is its code point; then come the end of a word and what merges make, in order.
END_ID = 0x110000
GAP = -1
#: Words of a block.
BLOCK = 50_000
#: Sums that a task holds before equal keys are put together.
HOLD = 1_000_000
STEP = "kind string, left string, right string, freq bigint, symbols binary, freqs binary"
Pair = tuple[str, str]


def symbol_ids(merges: Sequence[Pair]) -> dict[str, int]:
    """Numbers of the symbols other than characters; equal ones of different parts are one symbol."""
    ids = {END_OF_WORD: END_ID}
    for left, right in merges:
        ids.setdefault(left + right, END_ID + len(ids))
    return ids


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values


class Sums:
    """Sums by key over many blocks."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, HOLD

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.parts.append(summed(keys, values))
        self.size += len(self.parts[-1][0])
        if self.size > self.most:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts = [summed(*(np.concatenate(c) for c in zip(*self.parts)))]
        self.size = len(self.parts[0][0])
        self.most = max(HOLD, 2 * self.size)
        return self.parts[0]


def numbers(words: list[str]) -> np.ndarray:
    """The symbols of words, each with its end and a gap."""
    text = "".join(words)
    if OPEN in text or CLOSE in text:
        words = [w.replace(OPEN, "").replace(CLOSE, "") for w in words]
        text = "".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full(len(text) + 2 * len(words), END_ID, np.int32)
    out[np.arange(len(text)) + 2 * np.repeat(np.arange(len(words)), sizes)] = np.frombuffer(text.encode("utf-32-le"), np.int32)
    out[np.cumsum(sizes + 2) - 1] = GAP
    return out


def word_of(symbols: np.ndarray) -> np.ndarray:
    """The place of each symbol's word in its block."""
    gap = symbols == GAP
    return np.cumsum(gap) - gap


def pairs_of(symbols: np.ndarray, freqs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent pairs as one number each, and the frequencies of their words."""
    at = np.flatnonzero((symbols[:-1] != GAP) & (symbols[1:] != GAP))
    return symbols[at].astype(np.int64) << 32 | symbols[at + 1], freqs[word_of(symbols)[at]]


def merge(symbols: np.ndarray, left: int, right: int, both: int) -> tuple[np.ndarray, np.ndarray]:
    """symbols with each (left, right), from the left and without overlap, as one; and the places where they were."""
    hit = np.flatnonzero((symbols[:-1] == left) & (symbols[1:] == right))
    if left == right and len(hit):
        k = np.arange(len(hit))
        begin = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, k, 0))
        hit = hit[(k - begin) % 2 == 0]  # every other one of a run
    if len(hit):
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols = symbols.copy()
        symbols[hit] = both
        symbols = symbols[keep]
    return symbols, hit


def _rows(kind: str, left: list, right: list, freq: list, symbols: list | None = None, freqs: list | None = None) -> pa.RecordBatch:
    n = len(freq)
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary())
    columns = ([kind] * n, left, right, freq, symbols or [None] * n, freqs or [None] * n)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in STEP.split(", ")])


def _block(symbols: np.ndarray, freqs: np.ndarray) -> pa.RecordBatch:
    return _rows("block", [None], [None], [len(freqs)], [symbols.tobytes()], [freqs.tobytes()])


def _named(kind: str, keys: np.ndarray, sums: np.ndarray, ids: dict[str, int]) -> pa.RecordBatch:
    """Rows of the sums of pairs that aren't zero."""
    names = {v: k for k, v in ids.items()}
    name = lambda numbers: [names[i] if i in names else chr(i) for i in numbers.tolist()]
    keys, sums = keys[sums != 0], sums[sums != 0]
    return _rows(kind, name(keys >> 32), name(keys & 0xFFFFFFFF), sums.tolist())


def first_blocks(words: DataFrame) -> DataFrame:
    """Blocks of (word, freq), and by kind: change, the counts of pairs; symbol, those of symbols over distinct words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, single, held, n = Sums(), Sums(), [], 0

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            symbols, freqs = numbers(table.column(0).to_pylist()), table.column(1).to_numpy()
            pairs.add(*pairs_of(symbols, freqs))
            real = symbols[symbols != GAP].astype(np.int64)
            single.add(real << 32, np.ones(len(real), np.int64))
            return _block(symbols, freqs)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield made()
                n = 0
        if n:
            yield made()
        ids = symbol_ids([])
        yield _named("change", *pairs.total(), ids)
        yield _named("symbol", *single.total(), ids)

    return words.select("word", F.col("freq").cast("bigint").alias("freq")).mapInArrow(cut, STEP)


def merged_blocks(blocks: DataFrame, done: list[Pair], now: list[Pair]) -> DataFrame:
    """Blocks, made by the rules done, after merging pairs now, and what this changes, by kind.

    change: (left, right, freq) more or fewer; made: (left, right, freq), freq places merged, over
    distinct words; read: freq words; touched: freq words that had a pair.
    """
    ids = symbol_ids([*done, *now])
    number = lambda s: ids[s] if s in ids else ord(s)
    rules = [(number(a), number(b), ids[a + b]) for a, b in now]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, made, read, met = Sums(), [0] * len(rules), 0, 0
        for batch in batches:
            for one, many in zip(*batch.columns, strict=True):
                old, freqs = np.frombuffer(one.as_buffer(), np.int32), np.frombuffer(many.as_buffer(), np.int64)
                new, touched = old, np.zeros(len(freqs), bool)
                for k, rule in enumerate(rules):
                    before = new
                    new, hit = merge(before, *rule)
                    if len(hit):
                        touched[np.searchsorted(np.flatnonzero(before == GAP), hit)] = True
                        made[k] += len(hit)
                read, met = read + len(freqs), met + int(touched.sum())
                for symbols, sign in ((old, -1), (new, 1)):
                    pairs.add(*pairs_of(symbols[touched[word_of(symbols)]], freqs[touched] * sign))
                yield _block(new, freqs)
        yield _named("change", *pairs.total(), ids)
        yield _rows("made", [a for a, _ in now], [b for _, b in now], made)
        yield _rows("read", [None], [None], [read])
        yield _rows("touched", [None], [None], [met])

    return blocks.select("symbols", "freqs").mapInArrow(scan, STEP)


def recounted_blocks(blocks: DataFrame, done: list[Pair], now: list[Pair], keep: bool) -> DataFrame:
    """By kind: pair, the counts of all pairs after merging pairs now in blocks made by the rules done; with keep also the blocks."""
    ids = symbol_ids([*done, *now])
    number = lambda s: ids[s] if s in ids else ord(s)
    rules = [(number(a), number(b), ids[a + b]) for a, b in now]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Sums()
        for batch in batches:
            for one, many in zip(*batch.columns, strict=True):
                symbols, freqs = np.frombuffer(one.as_buffer(), np.int32), np.frombuffer(many.as_buffer(), np.int64)
                for rule in rules:
                    symbols, _ = merge(symbols, *rule)
                pairs.add(*pairs_of(symbols, freqs))
                if keep:
                    yield _block(symbols, freqs)
        yield _named("pair", *pairs.total(), ids)

    return blocks.select("symbols", "freqs").mapInArrow(scan, STEP)
