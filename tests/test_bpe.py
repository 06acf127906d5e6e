import pytest
from pyspark.sql import functions as F

from lexigrain.functions.text import unwrapped
from lexigrain.operators import bpe, words

LOW = "low " * 5 + "lower " * 2 + "newest " * 6 + "widest " * 3


@pytest.fixture(scope="module")
def low(spark):
    return words.word_count(spark.createDataFrame([(LOW,)], "text string"))


def encode(spark, word, merges):
    return spark.createDataFrame([(word,)], "w string").select(bpe.encode(F.col("w"), merges).alias("t")).first().t


def brute(vocab, merges, min_freq):
    """Plain training: lists of symbols, counts from nothing at every step."""
    state = {w: [*w, "</w>"] for w in vocab}
    rules = []
    for _ in range(merges):
        pairs = {}
        for w, n in vocab.items():
            for p in zip(state[w], state[w][1:]):
                pairs[p] = pairs.get(p, 0) + n
        best = min(pairs, key=lambda p: (-pairs[p], p[0].encode(), p[1].encode()), default=None)
        if best is None or pairs[best] < min_freq:
            break
        rules.append((*best, pairs[best]))
        for w, s in state.items():
            out = []
            for x in s:
                if out and (out[-1], x) == best and not (out[-1:] == [None]):
                    out[-1] = out[-1] + x
                    out.append(None)  # a merged symbol takes no part again
                else:
                    out.append(x)
            state[w] = [x for x in out if x is not None]
    return rules, state


def test_golden(spark, low):
    trace, vocab = bpe.train(low, 10)
    got = [(r.pair_a, r.pair_b, r.freq) for r in trace.orderBy("step").collect()]
    assert got == [("e", "s", 9), ("es", "t", 9), ("est", "</w>", 9), ("l", "o", 7), ("lo", "w", 7), ("e", "w", 6), ("ew", "est</w>", 6), ("n", "ewest</w>", 6), ("low", "</w>", 5), ("d", "est</w>", 3)]
    merges = bpe.merges_of(trace)
    assert encode(spark, "lowest", merges) == ["low", "est</w>"]
    for r in vocab.select("word", unwrapped(F.col("s")).alias("t")).collect():
        assert encode(spark, r.word, merges) == r.t and "".join(r.t) == r.word + "</w>"
    shots = spark.createDataFrame([("lowest",), ("zzz",)], "w string").select(F.size(bpe.encode_trace(F.col("w"), merges[:5])).alias("n")).collect()
    assert [r.n for r in shots] == [6, 1]


def test_against_brute_force(spark):
    text = "aaa aaaa banana bandana ananas nan null nan | \" , </w> 007 é éé été 日本 日本語 " * 3
    counts = words.word_count(spark.createDataFrame([(text,)], "text string")).repartition(3)
    vocab = {r.word: r.freq for r in counts.collect()}
    rules, state = brute(vocab, 25, 2)
    trace, final = bpe.train(counts, 25, every=4)
    assert [(r.pair_a, r.pair_b, r.freq) for r in trace.orderBy("step").collect()] == rules
    assert {r.word: r.t for r in final.select("word", unwrapped(F.col("s")).alias("t")).collect()} == state


def test_edges(spark, low):
    assert encode(spark, "lower", [("e", "r")]) == ["l", "o", "w", "er", "</w>"]
    assert encode(spark, "aaa", [("a", "a")]) == ["aa", "a", "</w>"]
    one = words.word_count(spark.createDataFrame([("ab",)], "text string"))
    trace, _ = bpe.train(one, 100, min_freq=1)
    assert trace.count() == 2
    assert bpe.train(one, 5, min_freq=2)[0].count() == 0
    assert bpe.train(one.limit(0), 5)[0].count() == 0
    stats = bpe.train(low, 1, stats=True)[0].first()
    # after e+s: l o w </w>, l o w e r </w>, n e w es t </w>, w i d es t </w>
    assert stats.vocab_size == 11 and abs(stats.avg_tok_len - (7 + 9 + 10 + 10) / (4 + 6 + 6 + 6)) < 1e-9
