from pyspark.sql import functions as F

from lexigrain.functions import text as T
from lexigrain.operators import words


def col(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_whitespace_tokens(spark):
    assert [len(t) for t in col(spark, "z" * 250, T.whitespace_tokens)] == [99, 99, 52]
    assert col(spark, "", T.whitespace_tokens) == [] and col(spark, " \t\n\x0b ", T.whitespace_tokens) == []
    assert col(spark, "a\x0bb", T.whitespace_tokens) == ["a", "b"]
    assert col(spark, "a b", T.whitespace_tokens) == ["a b"]
    assert col(spark, None, T.whitespace_tokens) is None


def test_alpha_lower(spark):
    assert col(spark, "The <UNK> x-1 Été_É", T.alpha_lower_tokens) == ["the", "<unk>", "x-", "t", "_"]


def test_hashes(spark):
    def reference(text, factor, start, mod):
        h = start
        for b in text.encode():
            h = (h * factor + b) % 2**64
        return h % mod

    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    for w in ("", "a", "hello", "Straße" * 9, "日本語" * 20):
        assert col(spark, w, T.djb2) == reference(w, 33, 5381, 100_003)
        assert col(spark, w, lambda x: T.times31(x, 100_003)) == reference(w, 31, 5381, 100_003)
        assert col(spark, w, T.fnv1a) == fnv(w)
        assert col(spark, w, lambda x: T.pair_times31(x, F.lit("é"), 4096)) == reference(w + "#é", 31, 5381, 4096)


def test_cells(spark):
    cells = {"007": (7.0, None), " -1.5e2 ": (-150.0, None), "": (None, ""), "nan": (None, "nan"), "1,5": (None, "1,5"), ".5": (0.5, None), "x": (None, "x")}
    for cell, wanted in cells.items():
        assert (col(spark, cell, lambda x: T.number_or_text(x)[0]), col(spark, cell, lambda x: T.number_or_text(x)[1])) == wanted


def test_labels(spark):
    names = {"a/seq_results.csv": "Sequential", "omp_4t.csv": "OMP-4t", "omp.csv": "omp", "MPI_2p_x.csv": "MPI-2p", "hybrid_2p.csv": "Hybrid-2p", "hybrid.csv": "Hybrid", "cuda.csv": "CUDA", "x.csv": "x", "d/omp_2t.csv/part-00000-c000.csv": "OMP-2t"}
    for name, label in names.items():
        assert col(spark, name, T.variant_label) == label


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "text string")
    assert words.totals(words.word_count(empty)).first() == (0, 0)
    assert tuple(words.corpus_stats(empty).first()) == (0, 0, 0, 0, 0)
    some = spark.createDataFrame([("a b a",), (None,), ("",)], "text string")
    assert tuple(words.corpus_stats(some).first()) == (3, 5, 3, 2, 3)
