"""Exact n-gram Jaccard join by filtering under several global token orders.

A document's set: the distinct 5-word shingles of its lower-cased (A-Z) words
`[^\\x20\\x09-\\x0D]+`, as 64-bit hashes; with fewer words the whole sequence is
one.  Documents with equal sets form a class, and classes are joined.

1. One scan deals the shingles, in sorted blocks, to buckets by shingle.  A bucket
   counts in how many classes each of its shingles is, and sends those of two or
   more back to the class.  Links need an overlap of 0.75 of the larger set, so
   a class with fewer shared shingles is done, linked with nothing.
2. Of m shared shingles of a set of n, a linked class has at least
   ceil(0.75 n), so under any global order the first m - ceil(0.75 n) + 1 of
   two linked classes have one in common.  Three orders are used: by frequency,
   and by two coarser frequency steps with different hashes inside a step, so a
   passage that many documents share comes last in all of them.
3. Of the classes that have a prefix shingle of the first order, the one with the
   fewest shingles of its own is the centre, and each class is compared with the
   centre that it meets most often.  Classes that are not yet connected then meet
   those that share a prefix shingle under each of the three orders, by
   intersecting the three lists of pairs; a pair is listed only if lengths, places
   and 512-bit maps of the sets allow the overlap.  Candidates are verified on the
   sets.  A group of near copies is thus connected by about as many pairs as members.

Nothing is capped, sampled or approximated but for 64-bit hash equality.

Defined results: null, blank and empty texts have an empty set, n_shingles 0 and
link with nothing; every input row gives a row, repeated ones too; a null id is
no candidate for component_id; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, shuffle_partitions

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Shingles that a task gathers before it sends a block to each bucket.
BLOCK = 1_500_000
#: Longs in the map of a set; 512 bits by the top 9 bits of a hash.
MAPS = 8


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x + np.uint64(salt)) * _P1
    x = (x ^ (x >> np.uint64(30))) * _P2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(n, len(ids))
    h = np.full(len(ids) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        h = mix(h ^ ids[j : len(ids) - size + 1 + j])
    return np.unique(h)


def planes(x: np.ndarray) -> bytes:
    """Differences of sorted numbers, byte by byte, so that leading zeros compress."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def numbers(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _frame(id_type: pa.DataType, **columns) -> pa.RecordBatch:
    """Rows of the exchange: bucket, kind (0 document, 1 shingles), class, doc_id, n, block, of."""
    n = len(columns["bucket"])
    types = {"bucket": pa.int32(), "kind": pa.int32(), "class": pa.int64(), "doc_id": id_type, "n": pa.int64(), "block": pa.binary(), "of": pa.binary()}
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns.get(k), pa.Array) else pa.nulls(n, t) if c is None else pa.array(c, t) for k, t in types.items()], list(types))


def _deal(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[int, np.ndarray] = {}
        total = 0

        def send() -> pa.RecordBatch:
            classes = np.fromiter(held, dtype=np.uint64, count=len(held))
            sets = list(held.values())
            tokens = np.concatenate(sets)
            of = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            order = np.argsort(tokens)
            tokens, of = tokens[order], of[order]
            bucket = (tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets + 1)))
            blocks, of_classes = [], []
            for a, b in zip(cuts, [*cuts[1:], len(tokens)], strict=True):
                used, at = np.unique(of[a:b], return_inverse=True)
                blocks.append(planes(tokens[a:b]))
                of_classes.append(np.uint32(len(used)).tobytes() + classes[used].tobytes() + np.ascontiguousarray(at.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())
            return _frame(field, bucket=bucket[cuts].astype(np.int32), kind=[1] * len(cuts), block=blocks, of=of_classes)

        field = pa.null()
        for batch in batches:
            field = batch.schema.field(0).type
            classes, sizes = [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, n)
                key = xxhash.xxh3_64_intdigest(s.tobytes())
                classes.append(key)
                sizes.append(len(s))
                if len(s) and key not in held:
                    held[key] = s
                    total += len(s)
                    if total >= BLOCK:
                        yield send()
                        held, total = {}, 0
            classes = np.array(classes, dtype=np.uint64)
            yield _frame(field, bucket=(classes % np.uint64(buckets)).astype(np.int32), kind=np.zeros(len(classes), dtype=np.int32), doc_id=batch.column(0), n=sizes, **{"class": _signed(classes)})
        if held:
            yield send()

    return docs.mapInArrow(deal, f"bucket int, kind int, class long, doc_id {kind}, n long, block binary, of binary")


def _count(dealt: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's shared shingles, dealt by class: block holds class, shingle and frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, classes, field = [], [], pa.null()
        for batch in batches:
            field = batch.schema.field("doc_id").type
            for raw, of in zip(batch.column("block").to_pylist(), batch.column("of").to_pylist(), strict=True):
                if raw is not None:
                    k = int(np.frombuffer(of[:4], dtype=np.uint32)[0])
                    at = np.ascontiguousarray(np.frombuffer(of[4 + 8 * k :], dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
                    tokens.append(numbers(raw))
                    classes.append(np.frombuffer(of[4 : 4 + 8 * k], dtype=np.uint64)[at])
            docs = batch.filter(pa.compute.is_null(batch.column("block")))
            if docs.num_rows:
                yield docs
        if not tokens:
            return
        tokens, classes = np.concatenate(tokens), np.concatenate(classes)
        order = np.lexsort((classes, tokens))
        tokens, classes = tokens[order], classes[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
        tokens, classes = tokens[new], classes[new]
        starts = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
        df = np.diff(np.append(starts, len(tokens)))
        df = np.repeat(df, df)
        keep = df > 1
        tokens, classes, df = tokens[keep], classes[keep], df[keep].astype(np.uint32)
        if not len(tokens):
            return
        bucket = classes % np.uint64(buckets)
        order = np.lexsort((classes, bucket))
        tokens, classes, df, bucket = tokens[order], classes[order], df[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets + 1)))
        ends = [*cuts[1:], len(tokens)]
        yield _frame(field, bucket=bucket[cuts].astype(np.int32), kind=[1] * len(cuts), block=[planes(classes[a:b]) for a, b in zip(cuts, ends, strict=True)], of=[tokens[a:b].tobytes() + df[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)])

    return dealt.repartition(buckets, "bucket").mapInArrow(count, dealt.schema)


def _prefixes(counted: DataFrame, buckets: int, share: tuple[int, int]) -> DataFrame:
    """Classes that can have links: class, n, their shared shingles, and the prefixes p1, p2, p3."""
    up, down = share

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, int] = {}
        classes, tokens, df = [], [], []
        for batch in batches:
            for c, n, raw, of in zip(*(batch.column(k).to_pylist() for k in ("class", "n", "block", "of")), strict=True):
                if raw is None:
                    sizes[c] = n
                else:
                    classes.append(numbers(raw))
                    k = len(classes[-1])
                    tokens.append(np.frombuffer(of[: 8 * k], dtype=np.uint64))
                    df.append(np.frombuffer(of[8 * k :], dtype=np.uint32))
        if not classes:
            return
        classes, tokens, df = map(np.concatenate, (classes, tokens, df))
        order = np.argsort(classes, kind="stable")
        classes, tokens, df = classes[order], tokens[order], df[order]
        cuts = np.flatnonzero(np.diff(classes, prepend=~classes[:1]))
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(classes)], strict=True):
            c = int(_signed(classes[a : a + 1])[0])
            n, m = sizes[c], b - a
            least = -(-up * n // down)
            if m >= least:
                t, f = tokens[a:b], df[a:b]
                k = m - least + 1
                step = np.log2(f).astype(np.uint64)
                p = [t[np.lexsort(o)[:k]] for o in ((mix(t, 1), f), (mix(t, 2), step), (mix(t, 3), step // np.uint64(2)))]
                bits = np.zeros(64 * MAPS, dtype=np.uint8)
                bits[t >> np.uint64(55)] = 1
                out.append((c, n, int(m), np.sort(t).tobytes(), *(_signed(x).tolist() for x in p), *np.packbits(bits).view(np.int64).tolist()))
                if len(out) == 500:
                    yield table(out)
                    out = []
        if out:
            yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3, *[pa.int64()] * MAPS]
        names = ["class", "n", "m", "tokens", "p1", "p2", "p3", *(f"b{i}" for i in range(MAPS))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = "class long, n long, m long, tokens binary, p1 array<long>, p2 array<long>, p3 array<long>" + "".join(f", b{i} long" for i in range(MAPS))
    return counted.select("bucket", "class", "n", "block", "of").repartition(buckets, "bucket").mapInArrow(prefixes, schema)


def _verified(pairs: DataFrame, classes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) that share prefix shingles under the second and third order, and then enough of their sets."""
    up, down = share
    side = lambda x: classes.select(F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "tokens", "p2", "p3")])
    meet = F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(meet).select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, a, b in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                both = len(np.intersect1d(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64), assume_unique=True))
                keep.append(down * both >= up * (n_a + n_b - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a long, b long")


def _candidates(classes: DataFrame, label: DataFrame, order: str, share: tuple[int, int]) -> DataFrame:
    """Pairs of classes in different components that share a prefix shingle under an order.

    Lengths, and what can follow the place of the shingle, must allow the overlap.
    The classes of a shingle's largest component never meet each other.
    """
    up, down = share
    sized = label.join(label.groupBy("component").agg(F.count("*").alias("size")), "component")
    rows = classes.join(sized, "class").select("class", "component", "size", F.posexplode(order).alias("at", "token"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("size", "component")).alias("most"))
    mixed = mixed.where("low < high").select("token", F.col("most.component").alias("top"))
    maps = [f"b{i}" for i in range(MAPS)]
    rows = rows.join(mixed, "token").join(classes.select("class", "n", "m", *maps), "class").withColumn("rest", F.col("m") - F.col("at"))
    side = lambda x, of: of.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "m", "component", "top", "rest", *maps)])
    only = lambda x, y: sum((F.bit_count(F.col(f"{c}_{x}").bitwiseAND(F.bitwise_not(f"{c}_{y}"))) for c in maps[1:]), F.bit_count(F.col(f"b0_{x}").bitwiseAND(F.bitwise_not(f"b0_{y}"))))
    need = F.lit(up) * (F.col("n_a") + F.col("n_b"))
    apart = (F.col("component_a") < F.col("component_b")) | (F.col("component_b") == F.col("top_b"))
    fit = apart & (F.lit(down) * F.least("n_a", "n_b") >= F.lit(up) * F.greatest("n_a", "n_b")) & (F.lit(up + down) * F.least("rest_a", "rest_b") >= need)
    fit &= (F.lit(up + down) * (F.col("m_a") - only("a", "b")) >= need) & (F.lit(up + down) * (F.col("m_b") - only("b", "a")) >= need)
    met = side("a", rows.where("component <> top")).join(side("b", rows), "token").where(fit)
    return met.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, share: tuple[int, int] = (75, 100)) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = shuffle_partitions(spark)
    counted = scratch.save(_count(_deal(source, n, buckets), buckets), "counted")
    documents = counted.where("kind = 0").select("doc_id", "class", "n")
    classes = scratch.save(_prefixes(counted, buckets, share), "classes")

    rows = classes.select("class", (F.col("n") - F.col("m")).alias("own"), F.explode("p1").alias("token"))
    first = rows.groupBy("token").agg(F.min(F.struct("own", "class")).alias("centre"), F.count("*").alias("size")).where("size > 1").select("token", F.col("centre.class").alias("first"))
    met = rows.join(first, "token").where("class <> first").groupBy("class", "first").agg(F.count("*").alias("times"))
    star = met.groupBy("class").agg(F.max(F.struct("times", "first")).alias("best")).select(F.col("class").alias("a"), F.col("best.first").alias("b"))
    links = scratch.save(_verified(scratch.save(star, "star"), classes, share), "links")
    group = scratch.save(connected_components(links, scratch, "one"), "group")
    label = scratch.save(classes.select("class").join(group.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("component", "class").alias("component")), "label")
    pairs = _candidates(classes, label, "p1", share)
    for order in ("p2", "p3"):
        pairs = pairs.join(_candidates(classes, label, order, share), ["a", "b"], "left_semi")
    more = scratch.save(_verified(scratch.save(pairs, "pairs"), classes, share), "more")
    if not more.isEmpty():
        group = connected_components(links.union(more), scratch, "two")

    full = documents.where("n > 0").join(group.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "n", F.coalesce("component", "class").alias("component"))
    low = full.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = full.join(low, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one document, the smallest id, of each linked group; all columns and rows of that id stay."""
    gone = components(docs, id_col=id_col, **options).where("component_id <> doc_id").select("doc_id").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kept = rows.join(gone, rows.doc.getField(id_col) == gone.doc_id, "left_anti")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
