"""Source divergence, periodic runs and token files against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import divergence, periodic_runs, token_files
from lexigrain.llm.queries import tokenizer_path, with_planted_runs

BYTE_BPE = tokenizer_path("byte_bpe_50k.json")


def plain_divergence(rows, min_docs=3, top=200):
    """rows: (lang, source, text); dense: every group and every kept term."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in words}:
        df = collections.Counter(w for x, _, ws in words if x == lang for w in set(ws))
        kept = sorted(w for w in df if df[w] >= min_docs)
        n = {s: collections.Counter() for x, s, _ in words if x == lang}
        for x, s, ws in words:
            if x == lang:
                n[s].update(w for w in ws if df[w] >= min_docs)
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (c.total() + len(kept)) for w in kept} for s, c in n.items()}
        every = sum(n.values(), collections.Counter())
        q = {w: 1 + 10**9 * (every[w] + 1) // (every.total() + len(kept)) for w in kept}
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in n:
            parts = {
                "pair": [(sum(gap(p[s][w], p[o][w]) for w in kept), o) for o in n if o != s],
                "term": [(gap(p[s][w], q[w]), w) for w in kept if n[s][w] and p[s][w] > q[w]],
            }
            for part, values in parts.items():
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


def audit(spark, rows, **options):
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "lang string, source string, text string, n int, term int").repartition(3)
    return df, [tuple(r) for r in divergence.divergence(df, **options).collect()]


def test_divergence_brute(spark):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("abCé", k=rnd.randint(1, 4))) for _ in range(120)]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "ç", None]), " ".join(rnd.choices(vocabulary[: rnd.choice([5, 40, 120])], k=rnd.randint(0, 40)))) for _ in range(150)]
    rows += [("fr", "x", "one two"), ("fr", "y", None), ("fr", "z", ""), ("xx", "lone", "ab ab, AB-ab1ab"), ("en", "bare", "12 34"), *[("en", "copies", "same TEXT twice")] * 4]
    for options in ({}, {"min_docs": 1, "top": 3}):
        _, got = audit(spark, rows, **options)
        assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, **options)
    df, _ = audit(spark, rows)
    assert divergence.divergence(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        divergence.divergence(df, min_docs=300)


def test_sketch_never_underestimates(spark):
    """A sketch that is far too small lets everything pass that is frequent enough, and the result stays."""
    rows = [("en", f"s{k % 3}", " ".join(chr(97 + (k * j) % 26) + chr(97 + (k + j) % 26) for j in range(30))) for k in range(60)]
    docs = divergence._documents(spark.createDataFrame(rows, "lang string, source string, text string").repartition(4), "text", "lang", "source")
    df = collections.Counter(w for _, _, t in rows for w in set(t.split()))
    for width in (divergence.BLOCK, 1 << 20):
        bits = np.frombuffer(divergence.possible_terms(docs, 3, width), dtype=np.uint8)
        words = [w.encode() for w in df]
        at = divergence.cells("en", words, width)
        passed = {w.decode() for w, ok in zip(words, (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0), strict=True) if ok}
        assert passed >= {w for w in df if df[w] >= 3}
        if width > divergence.BLOCK:
            assert len(passed) < len(df)
    assert set(audit(spark, rows, max_width=divergence.BLOCK)[1]) == plain_divergence(rows)


def plain_runs(words, least_words=6, least_periods=4):
    found = {}
    for q in range(1, len(words) // least_periods + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least_words, least_periods * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def runny(rnd):
    words = [rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 120))]
    for _ in range(rnd.randint(0, 5)):
        if words:
            period, start = rnd.randint(1, max(1, len(words) // 4)), rnd.randrange(len(words))
            for i in range(start + period, rnd.randint(start, len(words))):
                words[i] = words[i - period]
    return words


def test_runs_brute():
    rnd = random.Random(8)
    for _ in range(1500):
        words, periods = runny(rnd), rnd.choice([3, 4, 4, 6])
        assert periodic_runs.runs(np.array(words, dtype=np.int64), 6, periods) == plain_runs(words, 6, periods), words
    thue = [bin(i).count("1") % 2 for i in range(4000)]  # has no run of more than two periods
    assert periodic_runs.runs(np.array(thue)) == []
    assert periodic_runs.runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]


def test_periodic_runs(spark):
    rnd = random.Random(9)
    texts = [" ".join(f"w{x}" for x in runny(rnd)) for _ in range(60)] + [None, "", " \n\t", "é é  é\né é\té", "a b " * 20_000, "x", "a\x1cb " * 8]
    rows = [(k if k else None, t, 3) for k, t in enumerate(texts)] + [(5, texts[5], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()), key=str)
    want, cut = [], {}
    for k, t, _ in rows:
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", t or "") if w]
        found = plain_runs(words) if len(words) < 2000 else [(0, len(words), 2)]
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        cut[k] = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((k, len(words), found, cut[k]))
        cut[k] = cut[k] if found else t
    assert got == sorted(want, key=str)
    kept = periodic_runs.collapse_runs(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.text for r in kept.collect()} == cut
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0 and periodic_runs.collapse_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, least_periods=2)


def test_planted_runs(spark):
    texts = [" ".join(f"w{i}" for i in range(k % 50)) for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "a b c")], "doc_id long, text string")
    for r in with_planted_runs(docs).collect():
        words = texts[r.doc_id].split() if r.doc_id is not None else ["a", "b", "c"]
        h, n = zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b""), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert r.text.split() == words


def test_segment_round_trip():
    rnd = np.random.default_rng(2)
    for top in (1, 200, 256, 70_000, 1 << 31):
        for n in (0, 1, 63, 64, 511, 513, 5000):
            ids = rnd.integers(0, top, n).astype(np.uint32)
            ids[: n // 2] %= 300
            cuts = np.array([0, n // 3, n // 3, n])
            raw = token_files.segment(ids, [None, 4, 9], cuts, 2, 1) + b"\n"
            s = token_files.Segment(raw)
            assert (s.ids() == ids).all() and s.doc_ids == [None, 4, 9] and s.starts.tolist() == cuts.tolist() and (s.partition, s.number) == (2, 1)
            places = rnd.integers(0, n, 300) if n else []
            assert (s.at(places) == ids[places]).all() if n else len(s.at([])) == 0
    with pytest.raises(IndexError):
        s.at([5000])
    with pytest.raises(ValueError):
        token_files.Segment(b"something else" * 9)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTE_BPE)
    rnd = random.Random(6)
    odd = ["a  <|endoftext|> b<|endoftext|>", "x\n\ny  z \t w", " lead", "trail  ", "a b  c\x1c d\x85e", "it's 'S don't 12.5 ab,.", "日本 語 😀 é\nÀ, ß.", "​ zero", "  ", "\n", "a\r\n b", "\x00 a\x00b", None, "", "long" * 400 + " " + "word " * 9000]
    texts = odd + ["".join(rnd.choices("ab é1²,.'\n  \t\x00　\x85İ", k=rnd.randint(1, 30))) for _ in range(300)] + [" ".join(rnd.choices(["Alpha", "beta,", "gamma.", "öl"], k=40)) for _ in range(100)]
    rows = [(None if k == 3 else 7 if k in (50, 60) else k * 3 - 40, t, 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    path = str(tmp_path / "set")
    token_files.write_tokens(docs, path, BYTE_BPE, segment_tokens=2000)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at, stream = [], 0, []
    for doc_id, text, _ in order:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        at += len(ids)
        stream += ids
    got = sorted((tuple(r) for r in token_files.read_tokens(spark, path, with_ids=True).collect()), key=lambda r: r[1])
    assert got == want
    assert spark.read.parquet(f"{path}/index").count() > 5
    places = [0, len(stream) - 1, len(stream) + 5, -1, *rnd.sample(range(len(stream)), 500)]
    found = {r.place: r.id for r in token_files.lookup(spark, path, spark.createDataFrame([(p,) for p in [*places, 0]], "place long")).collect()}
    assert found == {p: stream[p] for p in places if 0 <= p < len(stream)}
    token_files.write_tokens(docs.limit(0), str(tmp_path / "none"), BYTE_BPE)
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0
    assert token_files.lookup(spark, str(tmp_path / "none"), docs.select(F.col("doc_id").alias("place"))).count() == 0


def test_word_cache_turns_over(monkeypatch):
    """Small caches and words over the kept length change nothing."""
    monkeypatch.setattr(token_files, "CACHE", 500)
    encode = token_files.ByteIds(BYTE_BPE)
    texts = [f"word{k % 7} other{k}, " + "x" * (k % 90) + "\nend." for k in range(200)]
    want = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert [b for k in range(0, 200, 9) for b in encode(texts[k : k + 9])] == want
    assert max(map(len, encode.known)) <= token_files.LONGEST
