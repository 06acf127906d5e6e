"""Benchmark decontamination: a hash set of normalised benchmark n-grams is
broadcast, document word windows are scanned against it, hits are verified word
by word, and hit spans or documents are removed.

A text is lower-cased (A-Z) and cut into words of digits, a-z and non-ASCII
characters.  A window is n consecutive item words; an item of fewer words, but
not none, is one window.

The benchmark is broadcast only while its text is at most ``max_broadcast``
bytes (checked by a query); a block in memory takes about 25 bytes a word and its
distinct words.  A larger one comes to the driver block by block below that size, and
the documents are scanned once a block: each block's hits are saved and its broadcast
destroyed before the next one, so memory stays bounded.  The hits of all blocks are
united before anything is counted or cut, and documents are not shuffled for their
text unless spans are cut.

Defined results: null text has no words; null items are no items; windows of an
item with null id mark words but count no item; repeated items and repeated
documents stand for themselves (items are counted by distinct id); empty tables
give empty results; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_BROADCAST = 16 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WindowSet:
    """The windows of some items.

    Item words are numbers in one array; a window is its first place there.  By window
    length: sorted hashes, the places in that order, and the item of each place.
    """

    def __init__(self, items: list[tuple], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        rows = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.uint32) for _, text in items]
        self.ids = np.concatenate([*rows, np.zeros(0, dtype=np.uint32)])
        length = np.array([len(r) for r in rows], dtype=np.int64)
        first, size = np.cumsum(length) - length, np.minimum(length, n)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(size[size > 0]).tolist():
            mine = np.flatnonzero(size == k)
            many = length[mine] - k + 1
            at = np.repeat(first[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
            of = np.repeat(mine, many).astype(np.int32)
            h = self._hash(self.ids, at, k)
            order = np.argsort(h, kind="stable")
            self.windows[k] = (h[order], at[order].astype(np.int32), of[order])

    @staticmethod
    def _hash(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(size):
            h = (h ^ ids[at + j].astype(np.uint64) * _MIX) * _STEP
            h ^= h >> np.uint64(31)
        return h

    def scan(self, texts: list) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
        """Words a text, the hit mask of all words with one gap after each text, and the items found by text."""
        ids, ends = [], []
        for text in texts:
            ids.extend(map(self.vocabulary.get, words(text), repeat(0)))
            ids.append(0)
            ends.append(len(ids))
        ids, ends = np.array(ids, dtype=np.uint32), np.array(ends, dtype=np.int64)
        counts = np.diff(ends, prepend=0) - 1
        mask = np.zeros(len(ids) + 1, dtype=np.int64)
        found: dict[int, set] = {}
        gaps = np.flatnonzero(ids == 0)
        run = np.diff(gaps, prepend=-1) - 1  # known words before each gap
        for size, (hashes, places, of) in self.windows.items():
            long = run >= size
            first, n = gaps[long] - run[long], run[long] - size + 1
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            h = self._hash(ids, at, size)
            low = np.searchsorted(hashes, h)
            near = hashes[np.minimum(low, len(hashes) - 1)] == h
            at, low, high = at[near], low[near], np.searchsorted(hashes, h[near], "right")
            text_of = np.searchsorted(ends, at, "right")
            for i, d, a, b in zip(at.tolist(), text_of.tolist(), low.tolist(), high.tolist(), strict=True):
                same = (self.ids[places[a:b, None] + np.arange(size)] == ids[i : i + size]).all(axis=1)
                if same.any():
                    mask[i] += 1
                    mask[i + size] -= 1
                    found.setdefault(d, set()).update(of[a:b][same].tolist())
        names = {d: {str(self.items[x]) for x in xs if self.items[x] is not None} for d, xs in found.items()}
        return counts, np.cumsum(mask)[:-1] > 0, names


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, max_broadcast: int) -> Iterator[list[tuple]]:
    """Items in lists of at most max_broadcast bytes, or a single item each; one list is in the driver at a time."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 32), F.lit(0))).first()[0]
    if size <= max_broadcast:
        yield [(r.i, r.t) for r in items.collect()]
        return
    out, left = [], max_broadcast
    for r in items.toLocalIterator():
        n = len(r.t.encode()) + 32
        if n > left and out:
            yield out
            out, left = [], max_broadcast
        out.append((r.i, r.t))
        left -= n
    yield out


def _one_block(benchmark: DataFrame, item_col: str, text_col: str, max_broadcast: int) -> list[tuple] | None:
    """The items if they are one block."""
    blocks = _blocks(benchmark, item_col, text_col, max_broadcast)
    first = next(blocks)
    return first if next(blocks, None) is None else None


def _hits(rows: DataFrame, blocks: Iterator[list[tuple]], n: int, scratch: Scratch) -> DataFrame:
    """(row, at, items) of the rows (row, text) that hold a window of any block: hit words and items, once each."""
    spark, parts = rows.sparkSession, None
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(WindowSet(block, n))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                counts, mask, items = shared.value.scan(batch.column(1).to_pylist())
                ends = np.cumsum(counts + 1)
                hit = np.flatnonzero(np.add.reduceat(mask, ends - counts - 1) > 0).tolist() if len(ids) else []
                at = [np.flatnonzero(mask[ends[d] - counts[d] - 1 : ends[d] - 1]).tolist() for d in hit]
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in hit], pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array([sorted(items.get(d, ())) for d in hit], pa.list_(pa.string()))], ["row", "at", "items"])

        part = scratch.save(rows.mapInArrow(scan, "row long, at array<long>, items array<string>"), f"hits{k}")
        shared.destroy()
        parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    block = _one_block(benchmark, item_col, item_text_col, max_broadcast)
    if block is None:
        return _in_blocks(source, _blocks(benchmark, item_col, item_text_col, max_broadcast), n, kind)
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(block, n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, mask, items = shared.value.scan(batch.column(1).to_pylist())
            ends = np.cumsum(counts + 1)
            total = np.concatenate([[0], np.cumsum(mask)])
            n_hit = total[ends] - total[ends - counts - 1]
            none = _digest([])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(n_hit), pa.array([len(items.get(i, ())) for i in range(len(counts))], pa.int64()), pa.array([_digest(list(items[i])) if items.get(i) else none for i in range(len(counts))]), pa.array(n_hit > 0)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return source.mapInArrow(scan, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _in_blocks(source: DataFrame, blocks: Iterator[list[tuple]], n: int, kind: str) -> DataFrame:
    """The same for a benchmark over the limit: one scan a block, then hits are joined by row."""
    scratch = Scratch(source.sparkSession)
    rows = scratch.save(source.withColumn("row", F.monotonically_increasing_id()), "rows")
    hits = _hits(rows.select("row", "text"), blocks, n, scratch)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(words(t)) for t in batch.column(2).to_pylist()], pa.int64())], ["row", "doc_id", "n_words"])

    sized = rows.select("row", "doc_id", "text").mapInArrow(count, f"row long, doc_id {kind}, n_words long")
    n_hit = F.coalesce(F.size("at"), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return sized.join(hits, "row", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, spans: bool = False, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs without the documents that hold a window, or (spans) with the hit words cut out.

    A cut runs from the first character of the first hit word to the last of the
    last in each run of hit words, of all blocks together; all other characters stay.
    All columns stay.
    """
    at = docs.columns.index(text_col)
    block = _one_block(benchmark, item_col, item_text_col, max_broadcast)
    if block is None:
        return _remove_in_blocks(docs, _blocks(benchmark, item_col, item_text_col, max_broadcast), text_col, n, spans)
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(block, n))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            counts, mask, _ = shared.value.scan(texts)
            ends = np.cumsum(counts + 1)
            bad = set(np.flatnonzero(np.add.reduceat(mask, ends - counts - 1) > 0).tolist()) if texts else set()
            if bad and spans:
                for d in bad:
                    texts[d] = _cut(texts[d], mask[ends[d] - counts[d] - 1 : ends[d] - 1])
                columns = batch.columns
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            else:
                yield batch.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_())) if bad else batch

    return docs.mapInArrow(clean, docs.schema)


def _remove_in_blocks(docs: DataFrame, blocks: Iterator[list[tuple]], text_col: str, n: int, spans: bool) -> DataFrame:
    """The same for a benchmark over the limit."""
    scratch = Scratch(docs.sparkSession)
    saved = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "rows")
    field = lambda c: F.col("doc").getField(c)
    hits = _hits(saved.select("row", field(text_col).alias("text")), blocks, n, scratch)
    if not spans:
        return saved.join(hits.select("row"), "row", "left_anti").select(*[field(c).alias(c) for c in docs.columns])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                mask = np.zeros(len(words(text)), dtype=bool)
                mask[places] = True
                out.append(_cut(text, mask))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    made = saved.select("row", field(text_col).alias("text")).join(hits.select("row", "at"), "row").mapInArrow(cut, "row long, text string")
    joined = saved.join(made, "row", "left")
    return joined.select(*[F.coalesce("text", field(c)).alias(c) if c == text_col else field(c).alias(c) for c in docs.columns])


def _cut(text: str, mask: np.ndarray) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    out, done, start, end = [], 0, None, 0
    for hit, m in zip([*mask.tolist(), False], [*WORD.finditer(raw.translate(_TABLE)), None], strict=True):
        if hit:
            start, end = m.start() if start is None else start, m.end()
        elif start is not None:
            out.append(raw[done:start])
            done, start = end, None
    return (b"".join(out) + raw[done:]).decode("utf-8", "surrogatepass")
