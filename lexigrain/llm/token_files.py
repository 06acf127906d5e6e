"""Token ids as binary files of directly addressable codes.

An id is cut into chunks of eight bits.  Level 0 holds the lowest chunk of every token and a
bitmap that tells which tokens go on; level k holds, without gaps, chunk k of those that do,
and so on.  A directory counts the set bits before every 512, so the place of a token in the
next level is a count of bits (rank), and any token is read from a few bytes of each level:
nothing before it is decoded.

A dataset is a folder of files, each a segment of whole documents, in ascending order of
document id, and a table ``index`` of the segments with the place of their first tokens.
Spark writes the files, by its text writer, as that takes any store, commits what a task
made only when it ended, and writes bytes as they are; a line end follows the segment.

A segment, all numbers little-endian, each section at a multiple of eight bytes:
    bytes 0-7    LXDAC1 and two zeros
    int64 x 6    partition, number within it, tokens, documents, documents of null id (they
                 come first), levels
    int64 x L    tokens of each level
    int64 x D    document ids (null: 0)
    int64 x D+1  first token of each document, and the end
    then for each level its chunks (bytes), its bitmap (64-bit words, lowest bit first) and
    its directory (int64, bits set before each eight words)

Rows are dealt by id, and repeated ids by their place in the input, so that none is hot; a
segment takes documents until it has ``segment_tokens``, so a task holds one segment and one
document.

Defined results: null and empty texts are the end id alone; a null id comes first; repeated
ids stand in order of their text; an empty table makes a folder with an empty index; other
columns are never read.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, compress, count
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import worker_cache

MAGIC = b"LXDAC1\0\0"
#: Set bits are counted before every so many words of a bitmap.
WORDS = 8
#: Bytes of known runs that a worker holds in each of two generations, and the longest run kept.
CACHE, LONGEST = 128 << 20, 64
#: Documents whose words are looked up together.
BATCH = 256
#: White space as the tokenizer's pattern has it: a run takes the one space before it, other
#: white space stands by itself but for the last character before a run.
_WHITE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUNS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+").findall


#: A mark for a word without a space before it, and a space before which words are cut.
_BARE = "\0"
_HAS_WHITE = re.compile(f"[{_WHITE}]").search


class ByteIds:
    """Ids of texts by a byte-level tokenizer, whose pattern never joins what white space parts.

    A text whose words are parted by one space or one line end each is cut at these, and
    words are looked up; a word of letters is one unit of the tokenizer's merge model, with
    its space.  Any other text is cut by the pattern of white space, or, if it holds a
    special token, encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as the machine has them, which must be 32 bits, little-endian")
        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.visible = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.end_marks = {m: self._encoded([m])[0] for m in ".,;:!?"}
        self.line_end = self._encoded(["\n"])[0]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, text: str) -> bytes:
        """Ids of letters with or without a space before them."""
        shown = text.replace(" ", self.visible[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.visible)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _words(self, words: set[str]) -> dict[str, bytes | None]:
        """Ids of words with the space before them, or of those marked _BARE without; None for what isn't one word."""
        out: dict[str, bytes | None] = {}
        rest: list[tuple[str, str]] = []
        for word in words:
            bare = word[:1] == _BARE
            core, mark = (word[1:] if bare else word), b""
            if core[-1:] in self.end_marks and core[:-1].isalpha():
                core, mark = core[:-1], self.end_marks[core[-1]]
            if core.isalpha():
                out[word] = self._letters(core if bare else f" {core}") + mark
            elif word == "\n":
                out[word] = self.line_end
            elif not core or _HAS_WHITE(core):
                out[word] = None
            else:
                rest.append((word, core if bare else f" {core}"))
        out.update(zip((w for w, _ in rest), self._encoded([t for _, t in rest]), strict=True))
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.size > CACHE:
            self.known, self.older, self.size = {}, self.known, 0
        marked = [bool(t) and any(m in t for m in self.marks) for t in texts]
        cut = [f"{_BARE}{t}".replace("\n", f" \n {_BARE}").split(" ") if t and not m and _BARE not in t else [] for t, m in zip(texts, marked, strict=True)]
        words = list(chain.from_iterable(cut))
        found = list(map(self.known.get, words))
        places = list(compress(count(), map(not_, found)))
        missing = {words[i] for i in places}
        fresh = {w: ids for w, ids in zip(missing, map(self.older.get, missing), strict=True) if ids}
        fresh.update(self._words(missing - fresh.keys()))
        odd = set()
        for word, ids in fresh.items():
            if ids is None:
                odd.add(word)
            elif len(word) <= LONGEST:
                self.known[word] = ids
                self.size += len(word) + len(ids) + 190
        for i in places:
            found[i] = fresh[words[i]]
        out, at = [], 0
        for text, mark, mine in zip(texts, marked, cut, strict=True):
            if mine and (not odd or odd.isdisjoint(mine)):
                out.append(b"".join(found[at : at + len(mine)]))
            elif mark or not text:
                out.append(self._encoded([text or ""])[0])
            else:
                out.append(b"".join(self._encoded(_RUNS(text))))
            at += len(mine)
        return out


def byte_ids(path: str) -> ByteIds:
    cache = worker_cache()
    if ("bytes", path) not in cache:
        cache["bytes", path] = ByteIds(path)
    return cache["bytes", path]


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def segment(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, partition: int = 0, number: int = 0) -> bytes:
    """A segment of the tokens of documents; starts has each document's first token and the end."""
    sections, sizes, rest = [], [], ids.astype(np.uint32)
    while len(rest) or not sizes:
        more = rest > 255
        bits = _padded(np.packbits(more, bitorder="little").tobytes())
        ones = np.bitwise_count(np.frombuffer(bits, dtype="<u8")).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(ones)])[: max(1, len(ones)) : WORDS]
        sections += [_padded((rest & 255).astype(np.uint8).tobytes()), bits, before.astype("<i8").tobytes()]
        sizes.append(len(rest))
        rest = rest[more] >> 8
    nulls = sum(d is None for d in doc_ids)
    head = np.array([partition, number, len(ids), len(doc_ids), nulls, len(sizes), *sizes, *(d or 0 for d in doc_ids), *starts], dtype="<i8")
    return b"".join([MAGIC, head.tobytes(), *sections])


class Segment:
    """Reads a segment from its bytes."""

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token segment")
        self.partition, self.number, self.tokens, docs, nulls, levels = map(int, np.frombuffer(raw, "<i8", 6, 8))
        at = 56
        sizes = np.frombuffer(raw, "<i8", levels, at).tolist()
        at += 8 * levels
        self.doc_ids: list[int | None] = [None] * nulls + np.frombuffer(raw, "<i8", docs, at).tolist()[nulls:]
        at += 8 * docs
        self.starts = np.frombuffer(raw, "<i8", docs + 1, at)
        at += 8 * (docs + 1)
        self.levels = []
        for n in sizes:
            words = -(-n // 64)
            chunks, at = np.frombuffer(raw, np.uint8, n, at), at + n + -n % 8
            bits, at = np.frombuffer(raw, "<u8", words, at), at + 8 * words
            marks = max(1, -(-words // WORDS))
            before, at = np.frombuffer(raw, "<i8", marks, at), at + 8 * marks
            self.levels.append((chunks, bits, before))

    def at(self, places) -> np.ndarray:
        """The ids at any places, each read by itself."""
        places = np.asarray(places, dtype=np.int64)
        if len(places) and not (0 <= places.min() and places.max() < self.tokens):
            raise IndexError("no such token")
        out, open_ = np.zeros(len(places), dtype=np.uint32), np.arange(len(places))
        for shift, (chunks, bits, before) in enumerate(self.levels):
            out[open_] |= chunks[places].astype(np.uint32) << np.uint32(8 * shift)
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            goes_on = (bits[word] >> bit & np.uint64(1)).astype(bool)
            open_, word, bit = open_[goes_on], word[goes_on], bit[goes_on]
            if not len(open_):
                break
            first = word // WORDS * WORDS
            places = before[word // WORDS] + np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            for k in range(WORDS - 1):  # whole words between the directory's mark and the token's
                inside = first + k < word
                places = places + np.where(inside, np.bitwise_count(bits[np.minimum(first + k, word)]), 0)
        return out

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out, open_ = np.zeros(self.tokens, dtype=np.uint32), np.arange(self.tokens)
        for shift, (chunks, bits, _) in enumerate(self.levels):
            out[open_] |= chunks.astype(np.uint32) << np.uint32(8 * shift)
            open_ = open_[np.unpackbits(bits.view(np.uint8), bitorder="little")[: len(chunks)].astype(bool)]
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, segment_tokens: int = 4_000_000) -> None:
    """Tokenize docs and write a dataset to the folder path: segments below ``data``, and ``index``."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    placed = source.repartitionByRange(F.asc_nulls_first("doc_id"), "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition, number = byte_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        held, names, starts = [], [], [0]

        def made() -> pa.RecordBatch:
            nonlocal number
            raw = segment(np.frombuffer(b"".join(held), dtype="<u4"), names, np.array(starts), partition, number)
            number += 1
            for x in (held, names, starts):
                x.clear()
            starts.append(0)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["data"])

        for batch in batches:
            for part in (batch.slice(at, BATCH) for at in range(0, batch.num_rows, BATCH)):
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    held += (ids, end)
                    names.append(doc_id)
                    starts.append(starts[-1] + len(ids) // 4 + 1)
                    if starts[-1] >= segment_tokens:
                        yield made()
        if names:
            yield made()

    segments = placed.select("doc_id", "text").mapInArrow(write, "data binary")
    segments.select(F.col("data").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{path}/data")
    heads = _files(spark, path).select("path", *[_number(F.col("content"), k).alias(c) for k, c in enumerate(("partition", "number", "tokens", "documents"))])
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads.withColumn("start", before).write.parquet(f"{path}/index")  # a row a segment


def lookup(spark: SparkSession, path: str, places: DataFrame, *, column: str = "place") -> DataFrame:
    """(place, id) of the tokens at any places of a dataset, each read by itself; places out of range give no row.

    Places, repeated ones once, are dealt to segments by blocks of 2**20 tokens.
    """
    block = 1 << 20
    index = spark.read.parquet(f"{path}/index")
    spread = index.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("tokens") - 1) / block))))
    wanted = places.select(F.col(column).cast("long").alias("place")).distinct().withColumn("block", F.floor(F.col("place") / block))
    inside = wanted.join(spread, "block").where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("tokens")))
    lists = inside.groupBy("partition", "number").agg(F.min("start").alias("start"), F.collect_list("place").alias("places"))  # no more than a segment has
    found = _segments(spark, path).join(lists, ["partition", "number"]).select("content", "start", "places")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column(0)):
                at = batch.column(2)[k].values.to_numpy()
                ids = Segment(raw.as_buffer()).at(at - batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids.astype(np.int64))], ["place", "id"])

    return found.mapInArrow(read, "place long, id long")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(content, partition, number) of each file."""
    return _files(spark, path).select("content", _number(F.col("content"), 0).alias("partition"), _number(F.col("content"), 1).alias("number"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/data")


def _number(raw, k: int):
    """The k-th 64-bit number of a head."""
    low_first = [F.hex(F.substring(raw, 9 + 8 * k + b, 1)) for b in range(7, -1, -1)]
    return F.conv(F.concat(*low_first), 16, 10).cast("long")


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """One row a document: doc_id, start (tokens before it in the dataset), n_tokens, ids_crc32, and with_ids its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(raw.as_buffer())
                ids, size = s.ids().astype("<u4"), np.diff(s.starts)
                parts = [ids[a:b] for a, b in zip(s.starts[:-1].tolist(), s.starts[1:].tolist(), strict=True)]
                columns = [pa.array(s.doc_ids, pa.int64()), pa.array(s.starts[:-1] + start), pa.array(size), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(s.starts, pa.int32()), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    index = spark.read.parquet(f"{path}/index").select("partition", "number", "start")
    return _segments(spark, path).join(index, ["partition", "number"]).select("start", "content").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
