"""Periodic runs of words: stretches that repeat with one period, found with bit-parallel lags.

A run is a stretch of words with smallest period q, of ``least_words`` words and
``least_periods`` periods at least, that no neighbouring word extends.

A text's words become ids, and bit k of all ids one big integer, a plane.  For a lag q each
plane is XORed with itself shifted by q, and the ORed planes tell in one integer where words
q apart differ.  ANDing the zeros with themselves, shifted by doubling steps, leaves what
begins a stretch of at least (periods - 1) * q equal words: the runs.  Lags come in ascending
order, so a stretch that was found with a smaller period is not found again.

Only lags that can have a run are tried.  A run of period q, with b <= q < 2b and b a power
of two, holds a block of b words that begins at a multiple of b, and the same block q later.
So for each b, window hashes at the multiples of b are compared with those up to 2b later, all
at once.  Blocks within a run that is known are passed over where q is a multiple of its
period, as these tell of that run only.  A hash collision costs a lag, never a run.  The work
of a text is its length times the logarithm, and its lags times its length over 64.

Defined results: null, empty and blank texts have no words and no runs, and collapse to '';
repeated rows and null ids are texts of their own; an empty table gives an empty result;
other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(31)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Run = tuple[int, int, int]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Odd hashes, so that none is the 0 that stands behind the end."""
    x = x * _A
    return (x ^ (x >> _C)) * _B | np.uint64(1)


def planes(ids: np.ndarray) -> list[int]:
    """Bit k of all ids as one integer, the first word lowest."""
    bits = range(int(ids.max()).bit_length()) if len(ids) else ()
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in bits]


def zero_stretches(of: list[int], n: int, q: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches of at least least words, each equal to the one q later."""
    differ = 0
    for plane in of:
        differ |= plane ^ (plane >> q)
    left, have = ~differ & ((1 << (n - q)) - 1), 1
    while left and have < least:
        step = min(have, least - have)
        left &= left >> step
        have += step
    if left:
        bits = np.unpackbits(np.frombuffer(left.to_bytes((n + 8) // 8, "little"), dtype=np.uint8), bitorder="little").view(np.int8)
        turns = np.flatnonzero(np.diff(bits, prepend=0, append=0))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            yield a, b - a + least - 1


def candidate_lags(hashes: np.ndarray, n: int, b: int, known: list[Run]) -> list[int]:
    """Lags from b to 2b - 1 at which a block of b words comes again, in ascending order."""
    blocks = (n - b) // b + 1
    padded = np.zeros((blocks + 1) * b, dtype=np.uint64)
    padded[: n - b + 1] = hashes
    same = padded[: blocks * b].reshape(blocks, b)[:, :1] == padded[b:].reshape(blocks, b)
    if not same.any():
        return []
    for start, length, period in known:
        end, first = start + length, -(-start // b)
        last = (end - 2 * b) // b  # the last block whose copy b words later is within the run
        column = -b % period
        inner = min(last, (end - 3 * b + 1) // b)  # up to here all copies are
        if inner >= first:
            same[first : inner + 1, column::period] = False
        for row in range(max(first, inner + 1), last + 1):
            same[row, column : end - 2 * b - row * b + 1 : period] = False
    return (np.flatnonzero(same.any(axis=0)) + b).tolist()


def runs(ids: np.ndarray, least_words: int = 6, least_periods: int = 4) -> list[Run]:
    """All runs (start, length, period) of word ids, by start and period."""
    n = len(ids)
    found: list[Run] = []
    seen: set[tuple[int, int]] = set()
    of, hashes, b = None, _mixed(ids.astype(np.uint64) + _C), 1
    while b * least_periods <= n and n >= least_words:
        known = [r for r in found if r[1] >= 2 * b]
        for q in candidate_lags(hashes, n, b, known):
            if q * least_periods > n:
                break
            of = planes(ids) if of is None else of
            for start, equal in zero_stretches(of, n, q, max(least_words - q, (least_periods - 1) * q, 1)):
                if (start, equal + q) not in seen:
                    seen.add((start, equal + q))
                    found.append((start, equal + q, q))
        hashes = _mixed(hashes[: n - 2 * b + 1] + _mixed(hashes[b:][: max(0, n - 2 * b + 1)] ^ _A)) if n >= 2 * b else hashes[:0]
        b *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words, one space between, without those that a run has after its first period."""
    if not found:
        return b" ".join(words)
    drop = np.zeros(len(words), dtype=bool)
    for start, length, period in found:
        drop[start + period : start + length] = True
    return b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d])


def _check(least_words: int, least_periods: int) -> None:
    if least_periods < 3 or least_words < 1:
        raise ValueError("least_periods must be 3 or more, as lags are chosen by whole blocks, and least_words positive")


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6, least_periods: int = 4) -> DataFrame:
    """One row a document: doc_id, n_words, runs (array of start, length, period) and collapsed, the text without repeats."""
    _check(least_words, least_periods)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lists, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.encode().split() if text else []
                found = runs(word_ids(words), least_words, least_periods)
                sizes.append(len(words))
                lists.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return source.mapInArrow(find, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def collapse_runs(docs: DataFrame, *, text_col: str = "text", least_words: int = 6, least_periods: int = 4) -> DataFrame:
    """docs with each text that has runs replaced by its collapsed one; all other columns and texts stay."""
    _check(least_words, least_periods)
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, text in enumerate(texts):
                words = text.encode().split() if text else []
                if found := runs(word_ids(words), least_words, least_periods):
                    texts[k] = collapsed(words, found).decode()
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(cut, docs.schema)
