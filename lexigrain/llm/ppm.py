"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A byte-context trie of depth 5 is trained on the corpus.  A context of five symbols
counts the occurrences of the next one, a shorter context the different contexts,
longer by a symbol, in which it came (update exclusion).  A symbol is coded under
the longest seen context.  The escape estimate takes ``DISCOUNT`` from each count: it
has the chance DISCOUNT * distinct / total, and goes to the next shorter context,
from which all symbols seen before are excluded; last comes a uniform choice of the
rest.  A text is its words, parted by one word mark, and an end; contexts run across
words, before the text are word marks, and every occurrence in a training text counts.

Contexts are exact and have no bound.  A symbol's probability depends on it and the
five before it, its gram.  Grams are counted, dealt and sorted by their last three
context symbols (which brings together all counts of depth 3 to 5 that a price needs;
those of depth 0 to 2, at most A ** 3 and in text far fewer, are sent to all), priced
in stretches, and join the documents.  The most frequent ``CACHE`` grams, and for the
base score ``TOP`` words of at most 64 bytes, are broadcast; that only spares the
shuffle of their rows, and the rest are joined, one row for each document and distinct
rare gram or word.

Text: A-Z lower-cased; words `[^\\x20\\x09-\\x0D]+`, then one end.  Documents whose
crc32 of the id as text, mod 7, is 2 are held out.

Defined results: a null, empty or blank text is the end alone; a null id counts as
an empty id text; every input row gives a row; repeated rows count and are scored
each; with no training document every symbol is uniform (score) and N = V = 0; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, worker_cache

A, WORD, END = 258, 256, 257  # bytes, the end of a word (also its start), the end of a text
DEPTH = 5
NEAR = 3  # context symbols by which grams are dealt
DISCOUNT = 0.4
CACHE = 3_000_000
#: Symbols that a task reads before it counts their grams, and counts that it keeps before it sends them.
READ_SYMBOLS = 2_000_000
KEPT_GRAMS = 3_000_000
#: Bytes of text that are taken at once, or one longer text.
TAKEN = 1_000_000
#: Grams that a task prices at once, or all of the same last NEAR context symbols.
PRICED = 1_000_000
TOP = 400_000
KEPT_WORDS = 600_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def held_out(doc) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol's gram, context (latest symbol first) * A + symbol, and the index of its text."""
    bodies = [b" ".join(words(t)) for t in texts]
    n = np.array([len(b) for b in bodies], dtype=np.int64)
    symbols = np.frombuffer(b"".join(b" " * DEPTH + b + b" " for b in bodies), dtype=np.uint8).astype(np.int64)
    symbols[symbols == 32] = WORD
    ends = np.cumsum(n + DEPTH + 1) - 1
    symbols[ends] = END
    inner = np.ones(len(symbols), dtype=bool)
    inner[((ends - n - DEPTH)[:, None] + np.arange(DEPTH)).ravel()] = False
    gram = symbols[DEPTH - 1 : -1]
    for depth in range(2, DEPTH + 1):
        gram = gram * A + symbols[DEPTH - depth : -depth]
    return (gram * A + symbols[DEPTH:])[inner[DEPTH:]], np.repeat(np.arange(len(n)), n + 1)


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, -1 where it isn't there."""
    at = np.searchsorted(sorted_keys, keys)
    found = at < len(sorted_keys)
    found[found] = sorted_keys[at[found]] == keys[found]
    return np.where(found, at, -1)


class Level:
    """Seen cells (context * A + symbol, sorted) of one depth with their counts, and sums by context.

    ``taken`` is, by context, what its symbols count in the context shorter by one:
    the exclusion that an escape from here brings there.
    """

    def __init__(self, cells: np.ndarray, counts: np.ndarray, shorter: Level | None):
        self.cells, self.counts = cells, counts.astype(np.float64)
        self.contexts, of = np.unique(cells // A, return_inverse=True)
        size = len(self.contexts)
        self.total, self.kinds = np.bincount(of, weights=self.counts, minlength=size), np.bincount(of, minlength=size)
        if shorter:
            self.taken = np.bincount(of, weights=shorter.counts[np.searchsorted(shorter.cells, parents(cells))], minlength=size)


def parents(cells: np.ndarray) -> np.ndarray:
    """The cells under the context shorter by its earliest symbol."""
    return cells // (A * A) * A + cells % A


def low_levels(cells: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels of depth 0 to NEAR - 1 from the cells of the last, which count contexts longer by one."""
    order = np.argsort(cells)
    tables = [(cells[order], counts[order])]
    while len(tables) < NEAR:
        tables.append(np.unique(parents(tables[-1][0]), return_counts=True))
    levels: list[Level] = []
    for table in reversed(tables):
        levels.append(Level(*table, levels[-1] if levels else None))
    return levels


def log10_prices(gram: np.ndarray, c: np.ndarray, low: list[Level]) -> np.ndarray:
    """log10 probability of each gram's symbol; the grams hold all of any last NEAR context symbols that they hold."""
    order = np.argsort(gram)
    order = order[c[order] > 0]
    tables = [(gram[order], c[order])]
    while len(tables) <= DEPTH - NEAR:
        tables.append(np.unique(parents(tables[-1][0]), return_counts=True))
    levels = list(low)
    for table in reversed(tables):
        levels.append(Level(*table, levels[-1]))

    p, left = np.zeros(len(gram)), np.arange(len(gram))
    total, kinds = np.zeros(len(gram)), np.zeros(len(gram))  # what is excluded
    for depth in range(DEPTH, -1, -1):
        level, cell = levels[depth], gram[left] // A ** (DEPTH - depth + 1) * A + gram[left] % A
        context, at = _at(level.contexts, cell // A), _at(level.cells, cell)
        here, coded = np.flatnonzero(context >= 0), at >= 0
        all_of, kinds_of = np.zeros(len(left)), np.zeros(len(left))
        all_of[here] = level.total[context[here]] - total[left[here]]
        kinds_of[here] = level.kinds[context[here]] - kinds[left[here]]
        p[left[coded]] += np.log10((level.counts[at[coded]] - DISCOUNT) / all_of[coded])
        escaped = ~coded & (kinds_of > 0)
        p[left[escaped]] += np.log10(DISCOUNT * kinds_of[escaped] / all_of[escaped])
        kinds[left[here]] = level.kinds[context[here]]
        if depth:
            total[left[here]] = level.taken[context[here]]
        left = left[~coded]
    p[left] -= np.log10(A - kinds[left])
    return p


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of a batch, at most 256 and about TAKEN bytes at once."""
    length = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(length.tolist()):
        if i > start and (size + n > TAKEN or i - start == 256):
            yield tuple(c.to_pylist() for c in batch.slice(start, i - start).columns)
            start, size = i, 0
        size += n
    if batch.num_rows:
        yield tuple(c.to_pylist() for c in batch.slice(start).columns)


def word_counts(source: DataFrame) -> DataFrame:
    """(word, c) over the training documents of (doc_id, text); the end is the word b"\\n"."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held_out(doc):
                    held.update(words(text))
                    held[b"\n"] += 1
            if len(held) > KEPT_WORDS:
                yield send()
                held.clear()
        yield send()

    return source.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def gram_counts(source: DataFrame) -> DataFrame:
    """(gram, c) of all documents of (doc_id, text); only training documents count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[tuple[np.ndarray, np.ndarray]] = []
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def tally() -> None:
            for counted in (True, False):
                gram, c = np.unique(np.concatenate([g[k == counted] for g, k in read]), return_counts=True)
                kept.append((gram, c if counted else np.zeros_like(c)))
            read.clear()

        def send() -> pa.RecordBatch:
            gram, c = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            order = np.argsort(gram)
            gram, c = gram[order], c[order]
            starts = np.flatnonzero(np.diff(gram, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(gram[starts]), pa.array(np.add.reduceat(c, starts))], ["gram", "c"])

        for batch in batches:
            for ids, texts in stretches(batch):
                gram, of = grams_of(texts)
                read.append((gram, ~np.array([held_out(i) for i in ids], dtype=bool)[of]))
                if sum(len(g) for g, _ in read) > READ_SYMBOLS:
                    tally()
                if sum(len(g) for g, _ in kept) > KEPT_GRAMS:
                    yield send()
        if read:
            tally()
        if kept:
            yield send()

    return source.mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def prices(grams: DataFrame) -> DataFrame:
    """(gram, c, p): log10 probability of each gram's symbol after its context."""
    spark = grams.sparkSession
    near = grams.where("c > 0").select(F.expr(f"gram div {A ** (DEPTH - NEAR + 1)} * {A} + gram % {A}").alias("cell")).distinct()
    low = near.groupBy(F.expr(f"cell div {A * A} * {A} + cell % {A}").alias("cell")).count().toArrow()  # at most A ** NEAR rows
    sent = spark.sparkContext.broadcast(tuple(c.to_numpy() for c in low.columns))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = low_levels(*sent.value)
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, (None,)):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < PRICED:
                    continue
            if not held:
                break
            gram, c = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            cut = len(gram)
            if batch is not None:
                deal = gram // A ** (DEPTH - NEAR + 1)
                cut = int(np.searchsorted(deal, deal[-1]))
            rest = (gram[cut:], c[cut:])
            gram, c = gram[:cut], c[:cut]
            held = [pa.RecordBatch.from_arrays([pa.array(x) for x in rest], ["gram", "c"])] if len(rest[0]) else []
            if len(gram):
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(c), pa.array(log10_prices(gram, c, levels))], ["gram", "c", "p"])

    dealt = grams.repartition(shuffle_partitions(spark), F.expr(f"gram div {A ** (DEPTH - NEAR + 1)}")).sortWithinPartitions("gram")
    return dealt.select("gram", "c").mapInArrow(price, "gram long, c long, p double")


def frequent(counts: DataFrame, top: int) -> DataFrame:
    """The rows of the highest count steps (eighths of a power of two) that together are at most top."""
    step = F.floor(F.log2("c") * 8)
    sizes = counts.where("c > 0").groupBy(step.alias("step")).count().collect()  # at most 8 * 63 rows
    least, left = math.inf, top
    for r in sorted(sizes, key=lambda r: -r["step"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    return counts.withColumn("cached", F.coalesce(step >= F.lit(float(least)), F.lit(False)))


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, cache_grams: int = CACHE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    counts = scratch.save(word_counts(source), "words")
    n_train, n_kinds, n_ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == F.lit(b"\n"), F.col("c"))), F.lit(0))).first()
    priced = scratch.save(prices(scratch.save(gram_counts(source), "grams")), "prices")
    priced = frequent(priced, cache_grams)
    cached = priced.where("cached").select("gram", "p").toArrow()
    grams, p = (c.to_numpy() for c in cached.columns)
    order = np.argsort(grams)
    known = frequent(counts, top).where(F.col("cached") & (F.octet_length("word") <= 64) & (F.col("word") != F.lit(b"\n"))).select("word", "c").toArrow()
    model = spark.sparkContext.broadcast((scratch.dir, grams[order], p[order], known.column(0).to_pylist(), np.log10(known.column(1).to_numpy() + 1.0)))
    end_base = math.log10(n_ends + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        name, *parts = model.value
        if cache.get("ppm", (None,))[0] != name:
            cache["ppm"] = (name, *parts[:2], dict(zip(parts[2], parts[3].tolist(), strict=True)))
        _, grams, prices_of, top_words = cache["ppm"]
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for ids, texts in stretches(batch):
                docs = [words(t) for t in texts]
                found, of = grams_of(texts)
                order = np.argsort(found)
                found, of = found[order], of[order]
                at = np.searchsorted(grams, found)
                hit = np.zeros(len(found), dtype=bool)
                inside = at < len(grams)
                hit[inside] = grams[at[inside]] == found[inside]
                scores = np.bincount(of[hit], weights=prices_of[at[hit]], minlength=len(ids)).tolist()
                missed, times = np.unique(of[~hit] * A ** (DEPTH + 1) + found[~hit], return_counts=True)
                first = row
                out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
                for doc, ws, value_of in zip(ids, docs, scores, strict=True):
                    rare = Counter(w for w in ws if w not in top_words)
                    known = len(ws) - rare.total()
                    for column, value in zip(out, (b"\n%d" % row, row, doc, 0, len(ws) + 1, known + (n_ends > 0), sum(map(top_words.get, ws, repeat(0.0))) + end_base, value_of), strict=True):
                        column.append(value)
                    for w, k in rare.items():
                        for column, value in zip(out, (w, row, None, k, None, None, None, None), strict=True):
                            column.append(value)
                    row += 1
                for x, k in zip(missed.tolist(), times.tolist(), strict=True):
                    which, gram = divmod(x, A ** (DEPTH + 1))
                    for column, value in zip(out, (b"\n\n%d" % gram, first + which, None, k, None, None, None, None), strict=True):
                        column.append(value)
                types = [pa.binary(), pa.int64(), batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["word", "row", "doc_id", "tf", "n_tokens", "known", "base", "score"])

    rows = source.mapInArrow(scan, f"word binary, row long, doc_id {kind}, tf long, n_tokens long, known long, base double, score double")
    rest = priced.where("not cached").select(F.concat(F.lit("\n\n"), F.col("gram").cast("string")).cast("binary").alias("word"), F.lit(None).cast("long").alias("c"), "p")
    table = counts.where(F.col("word") != F.lit(b"\n")).select("word", "c", F.lit(None).cast("double").alias("p")).union(rest)
    joined = rows.join(table, "word", "left")
    per = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(F.col("c").isNotNull(), F.col("tf")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1.0))).alias("logs"),
        F.sum(F.coalesce("score", F.col("tf") * F.col("p"))).alias("score"),
    )
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return per.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * math.log10(n_train + n_kinds + 1)).alias("base_score"), "score")


def adaptive(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 3) -> DataFrame:
    """(doc_id, score): log10 probability under a trie that starts empty and learns as it reads each document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def code(text: str | None) -> float:
        data = [*(text or "").encode("utf-8", "surrogatepass"), END]
        trie: dict[tuple, Counter] = {}
        out = 0.0
        for i, symbol in enumerate(data):
            excluded: set[int] = set()
            contexts = [tuple(data[max(0, i - k) : i]) for k in range(min(depth, i), -1, -1)]
            for context in contexts:
                seen = {s: c for s, c in trie.get(context, {}).items() if s not in excluded}
                if seen:
                    total = sum(seen.values()) + len(seen)
                    if symbol in seen:
                        out += math.log10(seen[symbol] / total)
                        break
                    out += math.log10(len(seen) / total)
                    excluded |= seen.keys()
            else:
                out -= math.log10(A - len(excluded))
            for context in contexts:
                trie.setdefault(context, Counter())[symbol] += 1
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([code(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return source.mapInArrow(scan, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
