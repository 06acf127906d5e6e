"""python -m lexigrain FILE [MERGES]: count a corpus' words, train merges, report, and encode sample words.

FILE is any path that Spark reads, of text whose words are parted by blanks or line ends.
MERGES is above 0; 50 unless given.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexigrain.functions.ranks import encode_words
from lexigrain.operators import bpe, words
from lexigrain.operators.bpe_index import Training
from lexigrain.operators.shared import Folder
from lexigrain.sources.files import read_stretches, write_csv

#: The words that the report encodes.
SAMPLE = ("the", "of", "and", "to", "in", "is", "that", "it")


def positive(text: str) -> int:
    if (n := int(text)) <= 0:
        raise argparse.ArgumentTypeError("must be above 0")
    return n


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexigrain", description=__doc__.split("\n")[0])
    out.add_argument("file")
    out.add_argument("merges", nargs="?", type=positive, default=50)
    out.add_argument("--min-freq", type=positive, default=2, help="stop when the best pair is rarer")
    out.add_argument("--state", help="folder of a training's state: kept there, and gone on from")
    out.add_argument("--trace", help="folder to write the trace to as CSV")
    out.add_argument("--separator", default=" ", help="white space at which long lines may be cut")
    out.add_argument("--top", type=positive, default=20)
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Run and print the report; its figures are returned too."""
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("lexigrain").getOrCreate()
    began = time.perf_counter()
    counts = Folder(spark).save(words.word_count(read_stretches(spark, given.file, given.separator)), "counts")
    total = words.totals(counts).first()
    seconds = time.perf_counter() - began
    print(f"Total tokens: {total.total_tokens}\nUnique tokens: {total.unique_tokens}\nSeconds: {seconds:.3f}\nTokens a second: {total.total_tokens / seconds:.2f}")
    top = words.top_words(counts, given.top).collect()
    for r in top:
        print(f"{r.freq:12d}  {r.word}")
    training = Training(counts, given.state)
    trace = training.run(given.merges, min_freq=given.min_freq)
    if given.trace:
        write_csv(trace, given.trace)
    for _, left, right, freq, ms, *_ in training.state["trace"]:
        print(f"{left!r} + {right!r}: {freq} ({ms:.0f} ms)")
    encoded = encode_words(counts, training.merges)
    sums = bpe.encoded_totals(counts, encoded).first()
    print(f"Words: {sums['words']}\nSubwords: {sums.subwords}\nSubwords a word: {sums.subwords_per_word:.4f}")
    found = {r.word: r.tokens for r in encoded.where(F.col("word").isin(*SAMPLE)).collect()}
    for word in SAMPLE:
        print(f"{word}: {' '.join(found[word]) if word in found else 'not found'}")
    return {"tokens": total.total_tokens, "unique": total.unique_tokens, "top": [tuple(r) for r in top], "merges": training.merges, "subwords": sums.subwords, "samples": found}


if __name__ == "__main__":
    main()
