"""Training by an index of pairs, several merges a job, resumed, compared; encoding by ranks."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_bpe import LOW, brute

from lexigrain.functions.ranks import RankEncoder, encode_distinct, encode_words
from lexigrain.functions.text import unwrapped
from lexigrain.operators import bpe, engines, words
from lexigrain.operators.bpe_index import Training, bucket_of, independent, key, train


def counted(spark, text):
    return words.word_count(spark.createDataFrame([(text,)], "text string")).repartition(3)


def rules_of(trace):
    return [(r.pair_a, r.pair_b, r.freq) for r in sorted(trace.collect(), key=lambda r: r.step)]


ODD = "aaa aaaa aaaaaaa banana bandana ananas nan null nan | \" , </w> </w </w> <//w>> 007 é éé été 日本 日本語 abc abcd bcd ab bc abc " * 3


def test_trace_is_that_of_single_merges(spark):
    rnd = random.Random(1)
    text = ODD + " ".join("".join(rnd.choices("abcd", [5, 3, 2, 1], k=rnd.randint(1, 9))) for _ in range(60))
    counts = counted(spark, text).cache()
    vocab = {r.word: r.freq for r in counts.collect()}
    rules, state = brute(vocab, 20, 2)
    training = Training(counts, stats=True)
    assert rules_of(training.run(20)) == rules
    assert len(training.state["jobs"]) < len(rules)
    assert {r.word: r.tokens for r in encode_words(counts, training.merges).collect()} == state
    # statistics that are carried on equal those of the words themselves
    for done in (1, 9, 20):
        _, after = brute(vocab, done, 2)
        used = [s for w in after.values() for s in w]
        _, _, _, _, _, size, mean = training.state["trace"][done - 1]
        assert size == len(set(used)) and abs(mean - sum(len(s.encode()) for s in used) / len(used)) < 1e-9


def plain_train(vocab, merges):
    """Fast single merges over lists, for many rules."""
    state, rules = {w: [*w, "</w>"] for w in vocab}, []
    for _ in range(merges):
        pairs = {}
        for w, s in state.items():
            for p in zip(s, s[1:]):
                pairs[p] = pairs.get(p, 0) + vocab[w]
        best = min(pairs, key=lambda p: (-pairs[p], p[0].encode(), p[1].encode()), default=None)
        if best is None or pairs[best] < 2:
            break
        rules.append((*best, pairs[best]))
        one = RankEncoder([best])
        state = {w: one(s) for w, s in state.items()}
    return rules


def test_choice_of_merges_is_safe():
    """Lists that one job merges, replayed without Spark over many random vocabularies."""
    rnd = random.Random(3)
    jobs = merges = 0
    for _ in range(60):
        vocab = {"".join(rnd.choices("abc/w<>"[: rnd.choice([2, 3, 7])], k=rnd.randint(1, 8))): rnd.randint(1, 6) for _ in range(rnd.randint(1, 25))}
        want, state, got = plain_train(vocab, 30), {w: [*w, "</w>"] for w in vocab}, []
        while len(got) < 30:
            pairs = {}
            for w, s in state.items():
                for p in zip(s, s[1:]):
                    pairs[p] = pairs.get(p, 0) + vocab[w]
            table = sorted(((*p, n) for p, n in pairs.items()), key=lambda p: (-p[2], p[0].encode(), p[1].encode()))
            head = table[: rnd.choice([2, 5, 100])]
            now = independent(head, 30 - len(got), 2, len(head) == len(table), {a + b for a, b, _ in got})
            if not now:
                break
            got += now
            jobs, merges = jobs + 1, merges + len(now)
            step = RankEncoder([p[:2] for p in now])
            state = {w: step(s) for w, s in state.items()}
        assert got == want
    assert jobs < merges


def test_five_hundred_merges(spark):
    rnd = random.Random(7)
    letters = [chr(0x4E00 + k) for k in range(1000)]
    apart = (rnd.choice(letters[600:]) + "".join(letters[2 * k : 2 * k + 2]) + rnd.choice(letters[600:]) for k in rnd.choices(range(300), [1 / (k + 20) for k in range(300)], k=12_000))
    parts = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 4))) for _ in range(40)]
    text = " ".join([*apart, *("".join(rnd.choices(parts, k=2)) for _ in range(500))])
    counts = counted(spark, text).cache()
    training = Training(counts)
    assert rules_of(training.run(500)) == plain_train({r.word: r.freq for r in counts.collect()}, 500)
    jobs = training.state["jobs"]
    assert len(jobs) <= 250  # jobs at least halved
    reads = [read / n for n, read in jobs]
    assert max(reads) * 3 < counts.count() and reads[-1] * 2 < reads[0]  # a job reads the words of its pairs


def test_postings_are_read_by_pair(spark):
    training = Training(counted(spark, ODD))
    plan = training.words_of([("a", "n")])._jdf.queryExecution().toString()
    bucket = bucket_of(key("a", "n"))
    assert f"bucket#" in plan and "PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket})" in plan and "PushedFilters: [IsNotNull(pair), EqualTo(pair,a\x01n)" in plan
    assert {r.word for r in training.words_of([("a", "n")]).collect()} == {"banana", "bandana", "ananas", "nan"}


def test_resumed(spark, tmp_path):
    counts, path = counted(spark, LOW).cache(), str(tmp_path / "state")
    assert len(rules_of(train(counts, 5, path=path, stats=True))) == 5
    again = Training(spark.createDataFrame([], "word string, freq bigint"), path)
    whole = Training(counts, stats=True)
    assert rules_of(again.run(10)) == rules_of(whole.run(10))
    assert [list(r[5:]) for r in again.state["trace"]] == [list(r[5:]) for r in whole.state["trace"]]
    names = again.folder.names()
    assert sum(n.startswith("state-") for n in names) == 1 and sum(n.startswith("pairs-") for n in names) == 1
    assert rules_of(Training(counts, path).run(3)) == rules_of(whole.run(10))[:3]  # a shorter one reads the trace only
    # a job that broke off before its state was named leaves nothing that counts
    again.folder.save(counts, f"pairs-{again.state['job'] + 1}")
    assert rules_of(Training(counts, path).run(12)) == rules_of(whole.run(12))


def test_folded_postings(spark, monkeypatch):
    from lexigrain.operators import bpe_index

    monkeypatch.setattr(bpe_index, "FOLD", 3)
    counts = counted(spark, ODD).cache()
    training = Training(counts)
    assert rules_of(training.run(8, together=1)) == brute({r.word: r.freq for r in counts.collect()}, 8, 2)[0]
    assert len(training.state["postings"]) <= 3


def test_training_edges(spark):
    one = counted(spark, "ab")
    assert train(one, 100, min_freq=1).count() == 2 and train(one, 5).count() == 0
    assert train(one.limit(0), 5).count() == 0
    assert train(one.where("word = 'ab'").withColumn("freq", F.lit(3).cast("bigint")), 1).first().pair_a == "a"


def test_ranks_equal_replay(spark):
    rnd = random.Random(5)
    for _ in range(300):
        rules = [("".join(rnd.choices("ab", k=rnd.randint(1, 2))), "".join(rnd.choices("ab", k=rnd.randint(1, 3)))) for _ in range(rnd.randint(0, 12))]
        word = "".join(rnd.choices("ab", k=rnd.randint(0, 14)))
        state = [*word, "</w>"]
        for rule in rules:
            state = RankEncoder([rule])(state)
        assert RankEncoder(rules)([*word, "</w>"]) == state
    tokens = spark.createDataFrame([("lowest",), ("aaa",), ("lowest",), ("",), (None,)], "word string")
    rules = [("l", "o"), ("a", "a"), ("lo", "w"), ("a", "a"), ("s", "t")]
    fast = {r.word: r.tokens for r in encode_distinct(tokens, rules).collect()}
    assert fast == {"lowest": ["low", "e", "st", "</w>"], "aaa": ["aa", "a", "</w>"], "": ["</w>"], None: None}
    slow = {r.word: r.tokens for r in bpe.encode_distinct(tokens.where("word <> ''"), rules).collect()}
    assert slow == {k: v for k, v in fast.items() if k}


def test_time_follows_words_not_rules():
    rnd = random.Random(1)
    words_ = [[*"".join(rnd.choices("etaoin", k=8)), "</w>"] for _ in range(4000)]
    common = [("e", "t"), ("t", "a"), ("a", "o"), ("o", "i"), ("i", "n")]
    took = []
    for n in (50, 5000):
        encode = RankEncoder([*common, *((f"x{k}", "y") for k in range(n))])
        began = time.process_time()
        for w in words_:
            encode(w)
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0]


def test_engines(spark):
    counts = counted(spark, LOW).cache()
    log = engines.compare(counts, 4)
    got = log.orderBy("iter").collect()
    assert [(r.left, r.right, r.pair_count) for r in got] == [("e", "s", 9), ("es", "t", 9), ("est", "</w>", 9), ("l", "o", 7)]
    assert all(r.t_seq_ms > 0 and r.t_par_ms > 0 and abs(r.speedup - r.t_seq_ms / r.t_par_ms) < 1e-9 for r in got)
    assert engines.compare(counts.limit(0), 4).count() == 0
    assert [r[:4] for r in engines.recount(counts, 4, every=2)] == [tuple(r)[:4] for r in got]


def test_recount_scans_blocks(spark, monkeypatch):
    """The recount is that of plain training, and merges no word's symbols as text, which took most of its time."""
    monkeypatch.setattr(bpe, "merge_pair", None)
    monkeypatch.setattr(bpe, "vocabulary", None)
    counts = counted(spark, ODD).cache()
    got = [r[1:4] for r in engines.recount(counts, 7, every=2)]
    assert len(got) == 7 and got == rules_of(train(counts, 7))


def test_command_line(spark, tmp_path, capsys):
    from lexigrain.__main__ import main, parser

    (tmp_path / "a.txt").write_text(LOW.replace(" ", "\n", 3) + " the the")
    out = main([str(tmp_path / "a.txt"), "10", "--trace", str(tmp_path / "trace.csv"), "--state", str(tmp_path / "state")], spark)
    assert (out["tokens"], out["unique"], len(out["merges"])) == (18, 5, 10) and out["top"][0] == ("newest", 6)
    assert out["samples"]["the"][-1].endswith("</w>") and "of: not found" in capsys.readouterr().out
    assert spark.read.csv(str(tmp_path / "trace.csv"), header=True).count() == 10
    assert len(main([str(tmp_path / "a.txt"), "12", "--state", str(tmp_path / "state")], spark)["merges"]) == 12
    assert parser().parse_args(["f"]).merges == 50
    for bad in (["f", "0"], ["f", "-3"], ["f", "x"], []):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)


def test_scanned_blocks(spark, monkeypatch, tmp_path):
    from lexigrain.operators import bpe_blocks, bpe_index

    monkeypatch.setattr(bpe_index, "SCAN", 1)
    monkeypatch.setattr(bpe_blocks, "BLOCK", 40)
    monkeypatch.setattr(bpe_blocks, "HOLD", 5)
    rnd = random.Random(2)
    text = ODD + "a\x01b \x02 \U0001f600\U0001f600 " * 3 + " ".join("".join(rnd.choices("ab</w>", k=rnd.randint(1, 9))) for _ in range(150))
    counts, path = counted(spark, text).cache(), str(tmp_path / "state")
    vocab = {}
    for r in counts.collect():
        vocab[r.word] = r.freq
    monkeypatch.setattr(bpe_index, "SCAN", 1 << 40)
    indexed = Training(counts, stats=True)
    indexed.run(40)
    monkeypatch.setattr(bpe_index, "SCAN", 1)
    scanned = Training(counts, path, stats=True)
    scanned.run(15)
    assert scanned.state["blocks"] and not any(n.startswith("postings") for n in scanned.folder.names())
    again = Training(spark.createDataFrame([], "word string, freq bigint"), path)
    again.run(25)
    trace = lambda t, n: [tuple(r[:4]) + tuple(r[5:]) for r in t.state["trace"][:n]]
    assert trace(again, 25) == trace(indexed, 25) and all(read == len(vocab) for _, read in again.state["jobs"])
    assert {r.word for r in again.words_of([again.merges[0]]).collect()} <= set(vocab)  # asks for the index, made of words as they are now
    monkeypatch.setattr(bpe_index, "MANY_LEFT", 1)
    monkeypatch.setattr(bpe_index, "RARE", 0)
    again.run(40)
    assert again.state["blocks"] is None and again.state["postings"] and trace(again, 40) == trace(indexed, 40)
    clean = {w.replace("\x01", "").replace("\x02", ""): 0 for w in vocab}
    for w, n in vocab.items():
        clean[w.replace("\x01", "").replace("\x02", "")] += n
    assert [r[1:4] for r in trace(indexed, 40)] == plain_train(clean, 40)
