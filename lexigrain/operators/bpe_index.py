"""Byte pair training with an index of pairs, several merges a job, and a state to go on from.

Postings list, for each pair, the words that have it.  A step reads the postings of its
pairs only: Parquet folders by a hash of the pair, and what later steps have added.  A word's
present symbols follow from the word and the rules so far, so a posting never goes stale: it
is a word that had the pair, and is passed over if it has it no more.

Steps of one job.  Pairs are taken in order, most frequent first, ties by the smaller left,
then right.  Merging (a, b) takes occurrences from pairs (x, a) and (b, y) only, and a pair
that it makes is no more frequent than one of these was.  So the next pair in order is the
best one after the merge too, unless it is itself of that kind; or one of that kind is as
frequent as it, and what grows out of that one is before it in order; or a = b, as (aa, aa) follows from (a, a) itself; or ab
is a symbol already, made of other parts.  There the job's list ends.  The trace is that of
one merge at a time.

Counts of pairs change by what changed words lose and gain.  Counts of symbols over distinct
words change by the number of merged places, so the size of the vocabulary in use and the
mean length need no scan.  A vocabulary of SCAN words or more is first merged as blocks of
symbols (bpe_blocks), each job a scan, as its frequent pairs are in much of it; it is indexed
when a job touched under one word in RARE and many merges are left.  What a job leaves, and a small file that names it, is the state
from which a stopped training goes on; the tables of earlier states are deleted.
"""

from __future__ import annotations

import time
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions.ranks import RankEncoder
from lexigrain.functions.text import CLOSE, END_OF_WORD, OPEN
from lexigrain.operators.bpe import TRACE
from lexigrain.operators.bpe_blocks import STEP, first_blocks, merged_blocks
from lexigrain.operators.shared import Folder, shuffle_partitions

BUCKETS = 32
#: Pairs of the table's head that come to the driver for one job.
HEAD = 512
#: Tables of added postings that are folded into one.
FOLD = 24
#: Words from which a vocabulary is scanned before it is indexed; the part of its words that a job touches at
#: most, and the merges left at least, when it is.
SCAN, RARE, MANY_LEFT = 50_000, 100, 100
#: Words that are worth a task.
TASK_WORDS = 5_000
POSTING = "pair string, word string, freq bigint, k int, bucket int"
PAIR = "left string, right string, freq bigint"
CHANGE = "kind string, left string, right string, pair string, word string, freq bigint, k int, bucket int"
Pair = tuple[str, str]
Counted = tuple[str, str, int]


def independent(head: Sequence[Counted], most: int, min_freq: int, complete: bool, existing: set[str] = frozenset()) -> list[Counted]:
    """The first pairs of a table in order that one job may merge, one after the other.

    complete: head is the whole table; else there may be more pairs of the last frequency,
    all behind its last pair.  A pair that makes one of the existing symbols ends the list,
    as it adds to counts that are there.
    """
    out: list[Counted] = []
    starts: dict[str, list[str]] = defaultdict(list)  # left symbol to what its merges make
    ends: dict[str, list[str]] = defaultdict(list)  # right symbol likewise
    symbols = {END_OF_WORD, *existing}
    rank = lambda left, right: (left.encode(), right.encode())

    def comes_first(tie: Counted, pair: Counted) -> bool:
        """Whether a pair that grows out of tie, and may be as frequent as pair, is before it in order."""
        made = [(x, y) for x in (tie[0], *ends.get(tie[0], ())) for y in (tie[1], *starts.get(tie[1], ()))]
        return any(rank(*p) < rank(*pair[:2]) for p in made if p != tie[:2])

    def unseen_first(pair: Counted) -> bool:
        """The same for ties behind the head, whatever they are."""
        if pair[0] == head[-1][0]:
            return bool(starts or ends)
        return any(b.encode() >= head[-1][0].encode() and s.encode() <= pair[0].encode() for b, made in ends.items() for s in made)

    for pair in head[:most]:
        left, right, freq = pair
        if freq < min_freq or out and (right in starts or left in ends):
            break
        if out and any(p[2] == freq and p not in out and comes_first(p, pair) for p in head):
            break
        if out and not complete and freq == head[-1][2] and unseen_first(pair):
            break
        out.append(pair)
        if left == right or left + right in symbols:
            break
        starts[left].append(left + right)
        ends[right].append(left + right)
        symbols.add(left + right)
    return out


def key(left: str, right: str) -> str:
    return f"{left}{OPEN}{right}"


def bucket_of(pair: str) -> int:
    return zlib.crc32(pair.encode()) % BUCKETS


def clean(word: str) -> str:
    """Without the two characters that mark symbols elsewhere."""
    return word.replace(OPEN, "").replace(CLOSE, "")


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def first_postings(counts: DataFrame, done: Sequence[Pair] = ()) -> DataFrame:
    """Postings of each pair of a word's symbols after the rules done, k times there."""
    encode = RankEncoder(done)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[Pair, tuple[str, int]] = {}
        for batch in batches:
            rows = []
            for word, freq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = encode([*clean(word), END_OF_WORD])
                for p, k in Counter(zip(s, s[1:])).items():
                    if p not in known:
                        known[p] = (key(*p), bucket_of(key(*p)))
                    pair, bucket = known[p]
                    rows.append((pair, word, freq, k, bucket))
            if rows:
                yield _table(rows, POSTING)

    return counts.select("word", F.col("freq").cast("bigint").alias("freq")).mapInArrow(cut, POSTING)


def merged_words(words: DataFrame, done: list[Pair], now: list[Pair]) -> DataFrame:
    """What merging pairs now changes in words (word, freq) after the rules done, by kind.

    change: (left, right, freq) more or fewer; posting: (pair, word, freq, bucket) of pairs new to
    a word; made: (left, right, freq), freq places merged, over distinct words; read: freq words.
    """
    before, after = RankEncoder(done), RankEncoder([*done, *now])
    pairs = set(now)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, made, read = defaultdict(int), Counter(), 0
        for batch in batches:
            rows = []
            read += batch.num_rows
            for word, freq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                old = before([*clean(word), END_OF_WORD])
                had = list(zip(old, old[1:]))
                if pairs.isdisjoint(had):
                    continue
                new = after.go_on(old, len(done), made)
                has = list(zip(new, new[1:]))
                for p in had:
                    change[p] -= freq
                for p in has:
                    change[p] += freq
                for p in set(has).difference(had):
                    pair = key(*p)
                    rows.append(("posting", None, None, pair, word, freq, 0, bucket_of(pair)))
            if rows:
                yield _table(rows, CHANGE)
        if read:
            rest = [(kind, a, b, None, None, n, 0, 0) for kind, found in (("change", change), ("made", made)) for (a, b), n in found.items() if n]
            yield _table([*rest, ("read", None, None, None, None, read, 0, 0)], CHANGE)

    return words.mapInArrow(merge, CHANGE)


class Training:
    """The state of a training in a folder.

    A new folder starts from counts (word, freq); one with a state goes on from it, whatever
    the counts are.  Without a path the folder goes when the session ends.
    """

    def __init__(self, counts: DataFrame, path: str | None = None, *, stats: bool = False):
        self.spark: SparkSession = counts.sparkSession
        self.folder = Folder(self.spark, path)
        states = [n for n in self.folder.names() if n.startswith("state-") and not n.endswith(".tmp")]
        if states:
            self.state = self.folder.get(max(states))
        else:
            self._begin(counts, stats)

    @property
    def merges(self) -> list[Pair]:
        return [(r[1], r[2]) for r in self.state["trace"]]

    def _begin(self, counts: DataFrame, stats: bool) -> None:
        kept = counts.select("word", F.col("freq").cast("bigint").alias("freq")).repartition(shuffle_partitions(self.spark))
        words = self.folder.save(kept, "words")  # counted once, whatever they come from
        self.state = {"job": 0, "trace": [], "symbols": None, "postings": [], "blocks": None, "words": words.count(), "touched": 0, "jobs": []}
        if self.state["words"] >= SCAN:
            self.state["blocks"] = "step-0"
            first = self.folder.save(first_blocks(words), "step-0")
            pairs = first.where("kind = 'change'").groupBy("left", "right").agg(F.sum("freq").alias("freq"))
            if stats:
                chars = first.where("kind = 'symbol'").groupBy("left").agg(F.sum("freq").alias("freq"))
                self.state["symbols"] = {r[0]: r[1] for r in chars.collect()}  # no more than there are characters
        else:
            side = lambda k: F.split_part("pair", F.lit(OPEN), F.lit(k))
            pairs = self._index().groupBy("pair").agg(F.sum(F.col("freq") * F.col("k")).alias("freq")).select(side(1).alias("left"), side(2).alias("right"), "freq")
            if stats:
                chars = words.select(F.explode(F.split(F.translate("word", OPEN + CLOSE, ""), "")).alias("c")).where("c <> ''").groupBy("c").count()
                self.state["symbols"] = {r[0]: r[1] for r in chars.collect()} | {END_OF_WORD: self.state["words"]}
        self.folder.save(pairs, "pairs-0")
        self._commit()

    def _index(self) -> DataFrame:
        """The postings of all words as they are now, in place of blocks."""
        words = self.folder.read("words", "word string, freq bigint")
        postings = first_postings(words, self.merges).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "pair")
        saved = self.folder.save(postings, "postings-0", "bucket")
        self.state["postings"], self.state["blocks"] = ["postings-0"], None
        return saved

    def _commit(self) -> None:
        """Name the state, then delete what it doesn't need."""
        name = f"state-{self.state['job']:06d}"
        self.folder.put(name, self.state)
        keep = {name, f"pairs-{self.state['job']}", *((self.state["blocks"], "words") if self.state.get("blocks") else ()), *(p.split("/")[0] for p in self.state["postings"])}
        self.folder.drop(*(n for n in self.folder.names() if n not in keep and n.split("-")[0] in ("state", "pairs", "postings", "step", "words")))

    def _postings(self, names: Sequence[str]) -> DataFrame:
        """The named tables: those in folders by bucket, and all that steps have added in one read."""
        reader = self.spark.read.schema(POSTING)
        added = [f"{self.folder.path}/{n}" for n in names if n.startswith("step-")]
        tables = [reader.parquet(f"{self.folder.path}/{n}") for n in names if not n.startswith("step-")]
        if added:
            tables.append(reader.option("recursiveFileLookup", "true").parquet(*added))
        return reduce(DataFrame.unionByName, tables)

    def words_of(self, pairs: Sequence[Pair], parts: int = 1) -> DataFrame:
        """(word, freq) that have, or had, one of the pairs: only these postings are read."""
        if self.state.get("blocks"):
            self._index()
        keys = [key(*p) for p in pairs]
        found = self._postings(self.state["postings"]).where(F.col("bucket").isin(sorted({bucket_of(k) for k in keys})) & F.col("pair").isin(keys))
        return found.select("word", "freq").repartition(parts, "word").dropDuplicates(["word"])

    def step(self, most: int, min_freq: int = 2) -> int:
        """Merge up to most pairs in one job; how many were merged."""
        began, state = time.perf_counter(), self.state
        head = [tuple(r) for r in self.folder.read(f"pairs-{state['job']}", PAIR).orderBy(F.desc("freq"), "left", "right").limit(HEAD).collect()]
        now = independent(head, most, min_freq, len(head) < HEAD, {a + b for a, b in self.merges})
        if not now:
            return 0
        job, pairs = state["job"] + 1, [p[:2] for p in now]
        if state.get("blocks") and job > 1 and most >= MANY_LEFT and state["touched"] * RARE < state["words"]:
            self._index()
        if state.get("blocks"):
            blocks = self.folder.read(state["blocks"], STEP).where("kind = 'block'")
            made = self.folder.save(merged_blocks(blocks, self.merges, pairs), f"step-{job}")
            state["blocks"] = f"step-{job}"
        else:
            made = self._looked_up(job, now)
        change = made.where("kind = 'change'").select("left", "right", "freq")
        table = self.folder.read(f"pairs-{state['job']}", PAIR).unionByName(change).groupBy("left", "right").agg(F.sum("freq").alias("freq"))
        self.folder.save(table.where("freq > 0"), f"pairs-{job}")
        sums = made.where("kind in ('made', 'read', 'touched')").groupBy("kind", "left", "right").agg(F.sum("freq").alias("freq")).collect()
        places = {(r.left, r.right): r.freq for r in sums if r.kind == "made"}
        size = {r.kind: r.freq for r in sums}
        ms = (time.perf_counter() - began) * 1000 / len(now)
        for left, right, freq in now:
            state["trace"].append((len(state["trace"]) + 1, left, right, freq, ms, *self._symbols(left, right, places.get((left, right), 0))))
        state["job"] = job
        state["touched"] = size.get("touched", 0)
        state["jobs"].append((len(now), size.get("read", 0)))
        if not state.get("blocks") and "kind=posting" in Folder(self.spark, f"{self.folder.path}/step-{job}").names():  # no new pair may have come up
            state["postings"].append(f"step-{job}/kind=posting")
        if len(state["postings"]) > FOLD:
            self._fold()
        self._commit()
        return len(now)

    def _looked_up(self, job: int, now: list[Counted]) -> DataFrame:
        """What merging pairs now changes, by the words of their postings."""
        pairs = [p[:2] for p in now]
        parts = min(shuffle_partitions(self.spark), 1 + sum(p[2] for p in now) // TASK_WORDS)  # a pair's words are no more than its frequency
        return self.folder.save(merged_words(self.words_of(pairs, parts), self.merges, pairs), f"step-{job}", "kind")

    def _symbols(self, left: str, right: str, places: int) -> tuple[int | None, float | None]:
        """Symbols in use and their mean bytes after merging so many places."""
        if (symbols := self.state["symbols"]) is None:
            return None, None
        for s, d in ((left, -places), (right, -places), (left + right, places)):
            symbols[s] = symbols.get(s, 0) + d
            if not symbols[s]:
                del symbols[s]
        return len(symbols), sum(len(s.encode()) * n for s, n in symbols.items()) / sum(symbols.values())

    def _fold(self) -> None:
        """Added postings into one table by bucket; the first table stays as it is."""
        first, *added = self.state["postings"]
        name = f"postings-{self.state['job']}-folded"
        self.folder.save(self._postings(added).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "pair"), name, "bucket")
        self.state["postings"] = [first, name]

    def run(self, merges: int, *, min_freq: int = 2, together: int = HEAD) -> DataFrame:
        """Train up to so many merges in all, together at most in one job; the trace."""
        while (left := merges - len(self.state["trace"])) > 0 and self.step(min(left, together), min_freq):
            pass
        return self.spark.createDataFrame([tuple(r) for r in self.state["trace"][:merges]], TRACE)


def train(counts: DataFrame, merges: int, *, min_freq: int = 2, stats: bool = False, path: str | None = None, together: int = HEAD) -> DataFrame:
    """The trace of a training; with a path, of one that goes on from the state there."""
    return Training(counts, path, stats=stats).run(merges, min_freq=min_freq, together=together)
