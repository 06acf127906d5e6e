"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a condition that rejects a document, and computes the columns that it
needs itself.  On a bounded sample (``sample_rows`` documents, picked by hash among
those that Spark reads first) each rule's share of rejected documents and its time
over that of cutting words are measured; rules then run in order of rejections per
cost, and a document that one rule rejects isn't shown to the next.  Times are the
least of some runs, and scores are rounded to powers of two, so that noise seldom
changes the order.  The order is all the sample decides: the verdict is the same in
any order.  Where base columns are asked for they are computed for every document,
and the cascade saves the other rules only.

Words are `[^\\x20\\x09-\\x0D]+`.  Base columns of a text: n_words; word_chars,
code points in words; n_symbols, characters of `[#*$%&|<>]`; n_dup_lines,
\\n-split lines with a word that equal an earlier line; n_repeat_words, words in
3-word windows found twice or more in the text, the first included.

Defined results: a null, empty or blank text has no words and fails the base
rule; repeated rows and null ids are judged alone; an empty table gives an empty
result; columns of the input that bear a result's name are not read.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, let, sql_words

SAMPLE_ROWS = 500
#: The sample is taken from one of so many hash classes; repeats of it in a run, and runs, of which the least counts.
CLASSES, REPEATS, RUNS = 8, 4, 2
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the array holds twice or more.

    Windows are compared by a 64-bit hash within one text.  Sorted hashes show
    which repeat; where those are few, each window is looked up among them, else
    (hash, place) pairs are sorted: n log n steps for n words in any case.
    """
    few = 32

    def hashes(ws: Column) -> Column:
        return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    def by_lookup(h: Column, again: Column) -> Column:
        return covered(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull()))

    def by_sort(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: covered(F.transform(F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h)), lambda x: x.i)))

    def places(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))
        return let(again, lambda g: F.when(F.size(g) == 0, 0).when(F.size(g) <= few, by_lookup(h, g)).otherwise(by_sort(h)))

    return let(words, lambda ws: let(hashes(ws), places))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def column_of(t: Column, ws: Column) -> dict[str, Column]:
    """The base columns of a text t of words ws, each computed where it is used."""
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(without(t, SYMBOLS))).cast("long"),
        "n_dup_lines": dup_lines(t).cast("long"),
        "n_repeat_words": repeat_words(ws).cast("long"),
    }


def with_words(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(sql_words(t), lambda ws: body(t, ws)))


def features(text: Column) -> Column:
    """A struct of the base columns."""
    return with_words(text, lambda t, ws: F.struct(*[c.alias(k) for k, c in column_of(t, ws).items()]))


def base_rules(f: Mapping[str, Column]) -> dict[str, Column]:
    return {"few_words": f["n_words"] < 50, "repeated_words": 100 * f["n_repeat_words"] > 50 * f["n_words"]}


def base_failed(f: Mapping[str, Column]) -> Column:
    few, repeated = base_rules(f).values()
    return few | repeated


def rules(text: Column, f: Mapping[str, Column]) -> dict[str, Column]:
    """The conditions that reject a document; f: its base columns."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return base_rules(f) | {
        "symbols": 10 * f["n_symbols"] > f["n_words"],
        "short_words": f["word_chars"] < 2 * f["n_words"],
        "long_words": f["word_chars"] > 20 * f["n_words"],
        "repeated_lines": (f["n_dup_lines"] > 4) & (2 * f["n_dup_lines"] > lines),
        "few_letters": 10 * count("[^ \\t\\n\\x0B\\f\\r]*\\p{L}[^ \\t\\n\\x0B\\f\\r]*") < 7 * f["n_words"],
        "exclamations": 10 * count("!") > 3 * f["n_words"],
        "capitals": 2 * count("\\p{Lu}") > count("\\p{L}"),
        "ellipses": 10 * count("(?m)(?:\\.\\.\\.|…)[ \\t]*$") > 3 * lines,
    }


def cascade_order(docs: DataFrame, text_col: str, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second, as measured on at most sample_rows documents."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    picked = docs.where(F.pmod(F.xxhash64(text), F.lit(CLASSES)) == 0).select(text.alias("text")).take(sample_rows)
    picked = picked or docs.select(text.alias("text")).take(sample_rows)
    scratch = Scratch(spark)
    sample = scratch.save(spark.createDataFrame(picked, "text string").repartition(min(len(picked), spark.sparkContext.defaultParallelism) or 1), "sample")
    often = sample.select(F.explode(F.array_repeat("text", REPEATS)).alias("text"))

    def measured(rule: Callable[[Column, Column], Column]) -> tuple[int, float]:
        job, times = often.agg(F.count_if(with_words(F.col("text"), rule))), []
        for _ in range(RUNS):
            began = time.perf_counter()
            rejected = job.first()[0]
            times.append(time.perf_counter() - began)
        return rejected, min(times)

    def rejects(name: str) -> Callable[[Column, Column], Column]:
        return lambda t, ws: rules(t, column_of(t, ws))[name]

    names = sorted(rules(F.lit(""), column_of(F.lit(""), F.array())))
    if picked:
        _, base = measured(lambda t, ws: F.size(ws) < 0)
        found = {k: measured(rejects(k)) for k in names}
        score = {k: round(math.log2((n + 0.5) / max(s - base, 0.1 * base))) for k, (n, s) in found.items()}
        names.sort(key=lambda k: (-score[k], k))
    scratch.drop("sample")
    return names


def verdict(text: Column, f: Mapping[str, Column], order: list[str]) -> Column:
    """True if the document stays: CASE stops at the first rule that rejects."""
    made = rules(text, f)
    out = F.when(made[order[0]], False)
    for name in order[1:]:
        out = out.when(made[name], False)
    return out.otherwise(True)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row a document: doc_id, the base columns, base_failed, kept."""
    order = cascade_order(docs, text_col, sample_rows)
    f = F.col("f")
    made = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("f", features(F.col("text")))
    return made.select("doc_id", *[f[k].alias(k) for k in FEATURES], base_failed(f).alias("base_failed"), verdict(F.col("text"), f, order).alias("kept"))


def keep_good(docs: DataFrame, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without those rejected; all columns stay."""
    order = cascade_order(docs, text_col, sample_rows)
    return docs.where(with_words(F.col(f"`{text_col}`"), lambda t, ws: verdict(t, column_of(t, ws), order)))
