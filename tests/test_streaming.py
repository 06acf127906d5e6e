"""Counts that a stream keeps: once each, through failures, folds and restarts."""

import collections

import pytest

from lexigrain.operators.word_store import WordStore
from lexigrain.streaming.words import kept_word_count


def found(spark, path):
    return {r.word: r.freq for r in WordStore(spark, path).counts().collect()}


def test_kept_counts(spark, tmp_path):
    source, path, want = tmp_path / "in", str(tmp_path / "counts"), collections.Counter()
    source.mkdir()

    def run():
        query = kept_word_count(spark.readStream.option("maxFilesPerTrigger", 1).text(str(source)), path, "value", fold=2).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()

    for k in range(5):
        text = " ".join(f"w{j}" for j in range(k + 1)) + "\nthe"
        want.update(text.split())
        (source / f"{k}.txt").write_text(text)
    run()
    assert found(spark, path) == want
    assert len(WordStore(spark, path).sets()) <= 3
    run()  # nothing new
    assert found(spark, path) == want
    (source / "late.txt").write_text("the end")
    want.update(["the", "end"])
    run()
    assert found(spark, path) == want


def test_batch_that_runs_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "counts")
    calls = []

    class Stream:  # keeps the function that foreachBatch gets
        class writeStream:  # noqa: N801
            @staticmethod
            def foreachBatch(f):  # noqa: N802
                calls.append(f)

    kept_word_count(Stream, path, fold=2)
    for number in (0, 1, 1, 2, 3, 3, 4, 4):
        calls[0](spark.createDataFrame([(f"a b{number}",)], "text string"), number)
    assert found(spark, path) == {"a": 5} | {f"b{k}": 1 for k in range(5)}
    with pytest.raises(KeyError):
        WordStore(spark, path).counts("none")
