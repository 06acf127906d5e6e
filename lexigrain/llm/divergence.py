"""Source divergence audit: how far the term frequencies of the sources of a language lie apart.

Terms are runs of letters A-Z, lower-cased, and non-ASCII characters.  A language keeps
the terms of at least ``min_docs`` of its documents.

1. One scan makes count-min sketches of document frequencies, a sparse part of each for
   every few thousand documents, keyed by language and term.  Parts are summed cell by
   cell, and what is left of the sum is one bit a cell: whether it reached min_docs.  A
   count-min cell never underestimates, so a term with a cell below min_docs is impossible.
   The bits, of a size that is bounded by ``max_width``, go to all workers.
2. A second scan counts terms by language and source, and discards impossible ones before
   anything is shuffled.  A sketch that is too full lets more pass, never fewer: survivors
   are counted exactly, and those below min_docs go.
3. All groups give all kept terms a frequency, zero counts too, but zero counts are never
   listed.  The value of two sources is that of two groups without any term, corrected by
   the histogram of counts of either, and by a join of the terms that both have.

All arithmetic is on integers; decimals hold the one product that may outgrow a long.

Defined results: null text, lang and source are ''; a source without terms is a group too;
repeated rows are documents of their own; equal values rank by the item's bytes; an empty
table gives an empty result; a language of one source has no pairs; other columns are never
read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

#: Bytes to terms: A-Z lower-cased, other ASCII a space.
TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
DEPTH = 3
#: Cells that are merged and sent together.
BLOCK = 1 << 14
#: Distinct terms that a task holds before it sends their counts.
HOLD = 400_000
SCALE = 1_000_000_000


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def sketch_width(docs: DataFrame, max_width: int) -> int:
    """Cells a row: a power of two by the size of the input, max_width at most."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max_width, 1 << max(20, (size // 64).bit_length()))


def cells(lang: str, words: list[bytes], width: int) -> np.ndarray:
    """The cell of each term in each row of the sketch, rows one after the other."""
    import xxhash

    seed = xxhash.xxh32_intdigest(lang)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))
    out = np.empty((DEPTH, len(words)), dtype=np.int64)
    for row in range(DEPTH):
        x = (h + np.uint64(row)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        out[row] = (x & np.uint64(width - 1)).astype(np.int64) + row * width
    return out


def _documents(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(part(lang_col).alias("lang"), part(source_col).alias("source"), part(text_col).alias("text"))


def possible_terms(docs: DataFrame, min_docs: int, width: int) -> bytes:
    """A bit for each cell of the merged sketch: whether min_docs documents may have its terms."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def part() -> pa.RecordBatch:
            at = np.concatenate([cells(lang, list(c), width) for lang, c in seen.items()], axis=1).ravel()
            n = np.tile(np.concatenate([np.fromiter(c.values(), dtype=np.int64, count=len(c)) for c in seen.values()]), DEPTH)
            order = np.argsort(at)
            at, n = at[order], n[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            at, n = at[first], np.minimum(np.add.reduceat(n, first), min_docs).astype(np.uint8)
            block = at // BLOCK
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = [*cuts[1:], len(at)]
            inside = (at % BLOCK).astype(np.uint16)
            data = [inside[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts], pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[lang].update(set(terms(text)))
            if sum(map(len, seen.values())) > HOLD:
                yield part()
                seen.clear()
        if any(seen.values()):
            yield part()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = held.setdefault(block, np.zeros(BLOCK, dtype=np.uint8))
                k = len(data) // 3
                at, n = np.frombuffer(data[: 2 * k], dtype=np.uint16), np.frombuffer(data[2 * k :], dtype=np.uint8)
                mine[at] = np.minimum(mine[at].astype(np.uint16) + n, min_docs)
        if held:
            bits = [np.packbits(x >= min_docs, bitorder="little").tobytes() for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(bits, pa.binary())], ["block", "data"])

    parts = docs.select("lang", "text").mapInArrow(sketch, "block int, data binary")
    merged = parts.repartition(shuffle_partitions(docs.sparkSession), "block").mapInArrow(merge, "block int, data binary")
    out = bytearray(DEPTH * width // 8)
    for row in merged.collect():  # DEPTH * width bits at most
        out[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = row.data
    return bytes(out)


def counted_terms(docs: DataFrame, min_docs: int, width: int, bits: bytes) -> DataFrame:
    """(lang, source, term, n, docs) of possible terms, and a row without a term for each group; several rows of each."""
    sketch = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.frombuffer(sketch.value, dtype=np.uint8)
        times: dict[tuple, Counter] = defaultdict(Counter)
        in_docs: dict[tuple, Counter] = defaultdict(Counter)

        def send() -> Iterator[pa.RecordBatch]:
            for (lang, source), counter in times.items():
                words = list(counter)
                at = cells(lang, words, width)
                keep = (found[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)
                words = [w for w, k in zip(words, keep, strict=True) if k]
                size, docs_of = len(words) + 1, in_docs[lang, source]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([None, *words], pa.binary()).cast(pa.string()),
                    pa.array([0, *map(counter.__getitem__, words)], pa.int64()), pa.array([0, *map(docs_of.__getitem__, words)], pa.int64()),
                ], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found_here = Counter(terms(text))
                times[lang, source].update(found_here)
                in_docs[lang, source].update(found_here.keys())
            if sum(map(len, times.values())) > HOLD:
                yield from send()
                times.clear()
                in_docs.clear()
        yield from send()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")


def smoothed(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)); null without terms."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", wide(n + 1) * SCALE, F.nullif(wide(total + kept), F.lit(0).cast("decimal(28,0)"))) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200, max_width: int = 1 << 25) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part `pair`: how far each other source of the language lies from the source, over all
    kept terms.  Part `term`: the source's terms that are more frequent than in the
    language, the ``top`` first.
    """
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs must be from 1 to 255, as a cell of the sketch is a byte")
    scratch = Scratch(docs.sparkSession)
    source = _documents(docs, text_col, lang_col, source_col)
    width = sketch_width(docs, max_width)
    found = counted_terms(source, min_docs, width, possible_terms(source, min_docs, width))
    counted = scratch.save(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted")

    by_lang = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("all_docs")).where(F.col("all_docs") >= min_docs).select("lang", "term", "all_n")
    rows = counted.where("term is not null").select("lang", "source", "term", "n").join(by_lang, ["lang", "term"])
    rows = scratch.save(rows, "rows")
    langs = rows.select("lang", "term", "all_n").groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_total"))
    groups = counted.where("term is null").select("lang", "source").join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda *names: [F.coalesce(c, F.lit(0)).alias(c) for c in names]
    groups = scratch.save(groups.select("lang", "source", *zero("total", "v", "lang_total")).withColumn("p0", smoothed(F.lit(0), F.col("total"), F.col("v"))), "groups")
    rows = rows.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", smoothed(F.col("n"), F.col("total"), F.col("v")).alias("p"), smoothed(F.col("all_n"), F.col("lang_total"), F.col("v")).alias("q"))
    rows = scratch.save(rows, "valued")
    scratch.drop("counted", "rows")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    values = pair_values(rows, groups).withColumnRenamed("other", "item").withColumn("rank", F.row_number().over(ranked))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(values, "pair").unionByName(out(own, "term"))


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value) for each two sources of a language, either way."""
    key = ["lang", "source", "other"]
    p, q, p0, q0 = map(F.col, ("p", "q", "p0", "q0"))
    size = groups.select("lang", "source", "v", "p0")
    pairs = size.join(size.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0")), "lang").where("source <> other")
    base = pairs.select(*key, F.coalesce(F.col("v") * gap(p0, q0), F.lit(0)).alias("value"))
    # terms of one count in a source differ alike from those that another source lacks
    counts = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    here = counts.join(pairs, ["lang", "source"]).select(*key, (F.col("k") * (gap(p, q0) - gap(p0, q0))).alias("value"))
    there = counts.select("lang", F.col("source").alias("other"), F.col("p").alias("q"), "k").join(pairs, ["lang", "other"]).select(*key, (F.col("k") * (gap(p0, q) - gap(p0, q0))).alias("value"))
    side = rows.select("lang", "term", "source", "p").join(size.select("lang", "source", "p0"), ["lang", "source"])
    both = side.join(side.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0")), ["lang", "term"]).where("source < other")
    fix = lambda a, b, a0, b0: gap(a, b) - gap(a, b0) - gap(a0, b) + gap(a0, b0)
    both = both.groupBy(*key).agg(F.sum(fix(p, q, p0, q0)).alias("value"), F.sum(fix(q, p, q0, p0)).alias("back"))
    back = both.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("back").alias("value"))
    parts = [x.groupBy(*key).agg(F.sum("value").alias("value")) for x in (here, there)] + [both.select(*key, "value"), back]
    for part in parts:
        base = base.unionByName(part)
    return base.groupBy(*key).agg(F.sum("value").alias("value"))
