"""Vector bin packing of examples into training sequences.

An example has three sizes: tokens, segments (1) and loss-bearing tokens.  A
sequence has a limit on each.  The dot-product heuristic fills a sequence: of
the open examples that fit, take the one whose sizes, as shares of the limits,
have the largest dot product with what is left in the sequence.  Where cutting
is allowed and nothing fits whole, the largest open example is cut to fill the
rest exactly.

Every partition packs its own rows from a bounded pool, so there is no shuffle
and memory doesn't grow with the input; each partition leaves at most one
sequence that isn't full, which is dealt into sequences of power-of-two length.
A task that is run again gives the same sequences, as it reads the same rows in
the same order; sequence ids hold the partition's number.

Defined results: null text is empty and packs as the end id alone; a null id,
repeated rows and ties are packed as they come (ties: the earlier example);
an empty table gives no pieces; other columns are never read.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

POOL = 2048
#: Words whose ids a worker keeps in each of two generations.
CACHE = 500_000


class Bins:
    """Streams (key, start, tokens, loss) examples into sequences."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool, view: int = 512):
        self.limits, self.cut, self.view = np.array([tokens, segments, loss], dtype=np.float64), cut, view
        self.waiting: deque[tuple] = deque()
        self.open: list[list] = []
        self.size = np.zeros((view, 3))

    def __len__(self) -> int:
        return len(self.waiting) + len(self.open)

    def add(self, examples: list[tuple]) -> None:
        """examples: (key, start, tokens, loss tokens)."""
        self.waiting.extend(examples)

    def _drop(self, i: int) -> None:
        """The last open example takes the place of i."""
        last = len(self.open) - 1
        self.open[i], self.size[i] = self.open[last], self.size[last]
        self.open.pop()

    def sequences(self, least: int) -> Iterator[list[tuple]]:
        """Sequences, as lists of (key, start, tokens), until at most least examples are open.

        A step looks at `view` open examples, which keeps its cost bounded.
        """
        while len(self) > least:
            left, out = self.limits.copy(), []
            while len(self):
                while self.waiting and len(self.open) < self.view:
                    key, start, tokens, loss = self.waiting.popleft()
                    self.size[len(self.open)] = (tokens, 1, loss)
                    self.open.append([key, start])
                view = self.size[: len(self.open)]
                fits = (view <= left).all(axis=1)
                if fits.any():
                    i = int(np.where(fits, view @ (left / self.limits**2), -1.0).argmax())
                    n = int(view[i, 0])
                elif self.cut and left[:2].min() >= 1:
                    i = int(view[:, 0].argmax())
                    n = int(min(left[0], left[2] + 1))
                else:
                    break
                key, start = self.open[i]
                out.append((key, start, n))
                if n >= view[i, 0]:
                    left -= view[i]
                    self._drop(i)
                else:
                    # the rest is an example of its own, whose first token bears no loss
                    left -= (n, 1, n - 1)
                    self.open[i][1] += n
                    self.size[i] -= (n, 0, n)
            if not out:  # an example over the limits that may not be cut: a sequence of its own
                out = [(*self.open[0], int(self.size[0, 0]))]
                self._drop(0)
            yield out


def powers(pieces: list[tuple], limit: int) -> Iterator[list[tuple]]:
    """Deal the pieces of a sequence that isn't full into sequences of power-of-two length."""
    total = sum(p[2] for p in pieces)
    sizes = [limit] if total == limit else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    queue = [list(p) for p in pieces]
    for size in sizes:
        out = []
        while size:
            key, start, n = queue[0]
            take = min(n, size)
            out.append((key, start, take))
            size -= take
            queue[0] = [key, start + take, n - take]
            if not queue[0][2]:
                queue.pop(0)
        yield out


def pack_examples(df: DataFrame, *, id_col: str, tokens_col: str, loss_col: str, max_tokens: int = 2048, max_segments: int = 64, max_loss: int = 2048) -> DataFrame:
    """Whole examples into sequences: id, tokens, loss_tokens, sequence_id, offset.

    For instruction data: tokens_col and loss_col hold an example's sizes (null: 0).
    An example over a limit gets a sequence of its own.
    """
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.col(loss_col), F.lit(0)).cast("long").alias("loss"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = TaskContext.get().partitionId() << 40, 0
        bins = Bins(max_tokens, max_segments, max_loss, cut=False)

        def rows(least: int) -> Iterator[tuple]:
            nonlocal done
            for sequence in bins.sequences(least):
                offset = 0
                for (key, loss), _, n in sequence:
                    yield key, n, loss, base + done, offset
                    offset += n
                done += 1

        names = ["id", "tokens", "loss_tokens", "sequence_id", "offset"]
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            bins.add([((i, l), 0, t, l) for i, t, l in zip(*(c.to_pylist() for c in batch.columns), strict=True)])
            if out := list(rows(POOL)):
                yield _batch(out, names, kind)
        if kind is not None and (out := list(rows(0))):
            yield _batch(out, names, kind)

    return source.mapInArrow(pack, f"id {source.schema['id'].dataType.simpleString()}, tokens long, loss_tokens long, sequence_id long, offset long")


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, kind if k == 0 else pa.int64()) for k, c in enumerate(columns)], names)


class WordIds:
    """Ids of texts by a tokenizer that drops white space: ids of each white-space run are kept.

    Runs of plain Latin text are cut by the tokenizer's own pattern, and letters
    go to its merge model at once; other runs take the tokenizer's whole way.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.runs: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.cut = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.odd = regex.compile(r"['\x00-\x1f\x7f-\xa0İɐ-\U0010ffff]|<\|").search
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.visible = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _part(self, text: str) -> bytes:
        if (ids := self.parts.get(text)) is None:
            tokens = self.tokenizer.model.tokenize("".join(map(self.visible.__getitem__, text.encode())))
            ids = self.parts[text] = np.array([t.id for t in tokens], dtype="<u4").tobytes()
        return ids

    def _run(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "replace")
        if self.odd(text) or not unicodedata.is_normalized("NFC", text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self._part, self.cut(text.lower())))

    def __call__(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        runs = text.encode("utf-8", "replace").split() if text else []
        try:
            return b"".join(map(self.runs.__getitem__, runs))
        except KeyError:
            if len(self.runs) > CACHE:
                self.older, self.runs = self.runs, {}
            if len(self.parts) > CACHE:
                self.parts.clear()
            known, older = self.runs, self.older
            for run in runs:
                if run not in known:
                    known[run] = older.get(run) or self._run(run)
            return b"".join(map(known.__getitem__, runs))


def word_ids(path: str) -> WordIds:
    cache = worker_cache()
    if ("ids", path) not in cache:
        cache["ids", path] = WordIds(path)
    return cache["ids", path]


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, max_tokens: int = 2048, max_segments: int = 512, max_loss: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack documents, cut where it saves padding.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with_ids the piece's ids.  A piece's first token has nothing before
    it and bears no loss, so a piece of n tokens has n - 1 that do.  max_loss is at
    least max_tokens - 1 here; pack_examples takes any limit.
    """
    if max_loss < max_tokens - 1:
        raise ValueError("max_loss below max_tokens - 1: use pack_examples")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = TaskContext.get().partitionId() << 40, 0
        encode, bins, kind = word_ids(tokenizer_path), Bins(max_tokens, max_segments, max_loss, cut=True), None

        def rows(sequences: Iterator[list[tuple]]) -> Iterator[tuple]:
            nonlocal done
            for sequence in sequences:
                offset = 0
                for (doc, first, ids, total), start, n in sequence:
                    part = ids[4 * (start - first) : 4 * (start - first + n)]
                    yield doc, start, n, zlib.crc32(part), total, base + done, offset, part
                    offset += n
                done += 1

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, kind if k == 0 else pa.int64()) for k, c in enumerate(columns[:7])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        def full(doc, ids: bytes, total: int, rest: list[tuple]) -> Iterator[list[tuple]]:
            whole = total // max_tokens
            for k in range(whole):
                yield [((doc, 0, ids, total), k * max_tokens, max_tokens)]
            if n := total - whole * max_tokens:
                start = whole * max_tokens
                rest.append(((doc, start, ids[4 * start :], total), start, n, n - 1))

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 1024):
                rest, out = [], []
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    ids = encode(text) + end
                    out += rows(full(doc, ids, len(ids) // 4, rest))
                bins.add(rest)
                out += rows(s for s in bins.sequences(POOL) for s in ([s] if sum(p[2] for p in s) == max_tokens else powers(s, max_tokens)))
                if out:
                    yield table(out)
        if kind is not None and (out := list(rows(s for s in bins.sequences(0) for s in powers(s, max_tokens)))):
            yield table(out)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(pack, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
