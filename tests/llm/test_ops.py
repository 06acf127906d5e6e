"""Each operator against a plain version, and its edge cases."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexigrain.llm import chat, decontaminate, jaccard, language_id, line_dedup, packing, ppm, quality, token_counts, warc
from lexigrain.llm.queries import tokenizer_path

LONG = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat"


def docs_frame(spark, texts, start=0):
    """Documents with an extra column of a clashing name."""
    return spark.createDataFrame([(i + start, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, score string").repartition(3)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rnd.choices(vocabulary, k=rnd.randint(30, 90))) for _ in range(25)]
    near = []
    for t in base[:12]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w).upper())
    return [*base, *near, *base[:4], None, "", " \n\t ", "a b", "A  b", "a", "ab " * 3000, "x\ny\nx"]


def test_jaccard_brute(spark, texts):
    sets = {}
    for i, t in enumerate(texts):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = list(range(len(texts)))
    for _ in group:
        for a in group[:]:
            for b in range(len(texts)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[group[i]] == group[i] for i in range(len(group))):
            break
    docs = docs_frame(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()}
    assert got == {i: (len(sets[i]), group[i]) for i in sets}
    assert jaccard.components(docs.limit(0)).count() == 0
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == {i for i in sets if group[i] == i}
    clashing = docs.withColumns({"__gone": F.lit(1), "doc": F.lit(2), "component_id": F.lit(3)})
    kept = jaccard.keep_one(clashing)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == {i for i in sets if group[i] == i}


def test_decontamination(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog and runs away fast"), (2, "Two words"), (3, None), (4, ""), (10, LONG)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_frame(spark, [f"Intro. THE quick, brown fox jumps over the lazy dog and! tail", "two  WORDS two words", "nothing of it", None, "", LONG + " tail " + LONG, "the quick brown fox jumps over the lazy dog"])
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, benchmark).collect()}
    assert [(rows[i].n_words, rows[i].n_hit, rows[i].n_items) for i in range(7)] == [(12, 10, 1), (4, 4, 1), (3, 0, 0), (0, 0, 0), (0, 0, 0), (43, 42, 1), (9, 0, 0)]
    assert rows[1].items_sha256 == hashlib.sha256(b"2").hexdigest() and rows[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    blocks = decontaminate.contamination(docs, benchmark, max_broadcast=60)
    assert {tuple(r) for r in blocks.collect()} == {tuple(r) for r in rows.values()}
    cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(docs, benchmark, spans=True).collect()}
    assert cut[0] == "Intro. ! tail" and cut[5] == " tail " and cut[2] == "nothing of it"
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4, 6} and kept.columns == docs.columns
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0


def test_decontamination_blocks(spark):
    """Items in blocks that overlap in one document are cut as in one block; repeated rows and items stay apart."""
    a, b = [f"a{k}" for k in range(1, 11)], [f"b{k}" for k in range(1, 6)]
    items = [(1, " ".join(a)), (2, " ".join(a[5:] + b)), (2, " ".join(a[5:] + b)), (None, "lone"), (3, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_frame(spark, [" ".join([*a, *b, "tail"]), " ".join([*a, *b, "tail"]), "a lone word " * 3000, None]).withColumns({"row": F.lit(1), "at": F.lit("x"), "doc": F.lit(2)})
    for spans in (True, False):
        one, many = (sorted(decontaminate.remove_contaminated(docs, benchmark, spans=spans, max_broadcast=m).collect(), key=lambda r: r.doc_id) for m in (1 << 20, 60))
        assert one == many and len(one) == (4 if spans else 1)
        if spans:
            assert [r.text for r in one] == [" tail", " tail", "a  word " * 3000, None]
    assert sorted(decontaminate.contamination(docs, benchmark).collect(), key=str) == sorted(decontaminate.contamination(docs, benchmark, max_broadcast=60).collect(), key=str)


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    odd = ["It's DON'T <|endoftext|> a<|startoftext|>b", "é ﬁ ΑΣ Σ İ 日本語 x y\x1cz", "1234 ½² !!!\x1f???", "naïve Straße", "word " * 9000]
    all_texts = [*texts, *odd]
    pieces = packing.pack_documents(docs_frame(spark, all_texts), tokenizer_path(), with_ids=True).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p.ids))
    for i, t in enumerate(all_texts):
        made = sorted(by_doc[i], key=lambda p: p.start)
        ids = [x for p in made for x in p.ids]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], t
        assert [p.start for p in made] == [sum(q.length for q in made[:k]) for k in range(len(made))]
        assert all(p.doc_tokens == len(ids) for p in made)
    for s in by_seq.values():
        s.sort(key=lambda p: p.offset)
        total = sum(p.length for p in s)
        assert [p.offset for p in s] == [sum(q.length for q in s[:k]) for k in range(len(s))]
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack_documents(docs_frame(spark, all_texts).limit(0), tokenizer_path()).count() == 0


def test_vector_limits(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(1, 900), rnd.randint(0, 300)) for i in range(400)] + [(900, 5000, 10), (901, None, None)]
    df = spark.createDataFrame(rows, "id long, n long, loss long")
    out = packing.pack_examples(df, id_col="id", tokens_col="n", loss_col="loss", max_tokens=1000, max_segments=4, max_loss=400).collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    for s in {r.sequence_id for r in out}:
        mine = [r for r in out if r.sequence_id == s]
        assert len(mine) == 1 or (sum(r.tokens for r in mine) <= 1000 and len(mine) <= 4 and sum(r.loss_tokens for r in mine) <= 400)


def test_quality_edges(spark, texts):
    rows = {r.doc_id: r for r in quality.quality(docs_frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        marked = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(marked), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality(docs_frame(spark, texts).limit(0)).count() == 0
    kept = quality.keep_good(docs_frame(spark, texts))
    assert kept.columns == docs_frame(spark, texts).columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in rows if rows[i].kept)
    assert quality.keep_good(docs_frame(spark, texts).limit(0)).count() == 0
    order = quality.cascade_order(docs_frame(spark, texts), "text")
    assert set(order) == set(quality.rules(F.lit(""), F.struct(*[F.lit(0).alias(c) for c in quality.FEATURES])))
    junk = docs_frame(spark, [LONG + " fine words here " + LONG.replace("lorem", "more") + " and then some others follow to reach fifty words in all so that it stays", "### $$$ %%% " * 40])
    assert [r.kept for r in quality.quality(junk).orderBy("doc_id").collect()][1] is False


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, old[j + 1] + 1, old[j] + (x != y)))
    return row[-1]


def within(a, b, most):
    """Whether a and b are at most so many edits apart: the table's band around its diagonal."""
    if abs(len(a) - len(b)) > most or sum(abs(a.count(c) - b.count(c)) for c in set(a)) > 2 * most:
        return False
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        low, new = max(0, i - most), {}
        for j in range(low, min(len(b), i + most) + 1):
            new[j] = min(row.get(j, most + 1) + 1, new.get(j - 1, most + 1) + 1, row.get(j - 1, most + 1) + (j > 0 and x != b[j - 1])) if j else i
        row = new
    return row.get(len(b), most + 1) <= most


def line_groups(texts):
    """The smallest index reachable by edit similarity of 0.9 or more, over all pairs."""
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if root(i) != root(j) and within(a, texts[j], int(0.1 * max(len(a), len(texts[j])) + 1e-9)):
                group[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_line_dedup(spark):
    other = "stet clita kasd gubergren no sea takimata sanctus est lorem ipsum dolor sit amet at vero eos et accusam"
    long = " ".join(f"{w}{k}" for k in range(10) for w in LONG.split())
    lines = ["short line", long, long.upper() + "!", long.replace("dolor3 ", "color3 "), other]
    docs = docs_frame(spark, [f"{lines[1]}\n{lines[0]}", f"{lines[2]}\n{lines[4]}\n{lines[0]}", lines[3], f"{lines[4]}\n\nnew words that nobody else has written in any other place", None, ""])
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.line_counts(docs).collect()}
    assert got == {0: (2, ""), 1: (3, "0,2"), 2: (1, "0"), 3: (3, "0"), 4: (0, ""), 5: (1, "")}
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[1] == other and 2 not in texts and texts[4] is None and texts[5] == ""
    assert line_dedup.line_counts(docs.limit(0)).count() == 0


def test_line_rows_and_ids(spark):
    """Rows are told apart even with one id, repeated rows keep their lines once, ids may be strings or null."""
    rows = [("a", "some line that is written twice here"), ("b", "some line that is written twice here\nown words of the second row b"), ("b", "first own line of another row b\nlast"), ("b", "first own line of another row b\nlast"), (None, "null ids come first of all\nlast"), ("c", "--- \n --- \n")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"row": F.lit(1), "removed": F.lit("x"), "doc": F.lit(2)}).repartition(3)
    assert sorted((r.doc_id or "", r.n_lines, r.n_removed) for r in line_dedup.line_counts(docs).collect()) == [("", 2, 0), ("a", 1, 0), ("b", 2, 1), ("b", 2, 1), ("b", 2, 2), ("c", 3, 0)]
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or "", r.text) for r in kept.collect()) == [("", "null ids come first of all\nlast"), ("a", "some line that is written twice here"), ("b", "first own line of another row b"), ("b", "own words of the second row b"), ("c", "--- \n --- \n")]


def test_line_links_are_similar(spark):
    """Groups are those of all pairs of similar lines, whatever is broadcast and however crowded keys are."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(200)]
    texts = []
    for _ in range(8):
        base = rnd.choices(words, k=60)
        for _ in range(12):
            w = base[:]
            w[rnd.randrange(60)] = rnd.choice(words)
            texts.append(" ".join(w))
    out = {r.doc_id: r.n_removed for r in line_dedup.line_counts(docs_frame(spark, texts)).collect()}
    assert [i for i in range(96) if not out[i]] == sorted(set(line_groups(texts))) == list(range(0, 96, 12))
    # a phrase that all lines share, at each line's own words: its keys are crowded
    phrase = [f"{t} as it is said in all of them {t[::-1]}" for t in texts]
    crowded = {r.doc_id: r.n_removed for r in line_dedup.line_counts(docs_frame(spark, phrase), crowd=3, broadcast_lines=0).collect()}
    assert out == crowded


def test_line_groups_brute(spark):
    """500 lines of 5 to 120 words with typos and changed words: groups against all pairs, by recall."""
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghijklmnoprstuvw", k=rnd.randint(2, 9))) for _ in range(900)]
    texts = []
    while len(texts) < 500:
        n = rnd.choice([5, 6, 8, 10, 12, 16, 20, 30, 40, 60, 90, 120])
        base = rnd.choices(words, k=n)
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            w = base[:]
            for _ in range(rnd.randint(1, max(1, n // 12))):
                k = rnd.randrange(n)
                w[k] = rnd.choice(words) if rnd.random() < 0.5 else "y" + w[k][1:]
            texts.append(" ".join(w))
    group = line_groups(texts)
    out = {r.doc_id: r.n_removed for r in line_dedup.line_counts(docs_frame(spark, texts)).collect()}
    wanted = [i for i in range(len(texts)) if group[i] != i]
    assert not [i for i in range(len(texts)) if out[i] and group[i] == i]
    found = sum(out[i] for i in wanted)
    print(f"lines found: {found} of {len(wanted)}")
    assert len(wanted) > 150 and found >= 0.95 * len(wanted)


def test_line_recall(spark):
    """Of the copies with edit similarity >= 0.9 (brute force) almost all are connected, at each length."""
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghijklmnoprstuvw", k=rnd.randint(2, 9))) for _ in range(400)]
    texts, pairs = [], collections.defaultdict(list)
    for n, typos in [(6, False), (6, True), (12, False), (20, False), (20, True), (60, False), (60, True), (120, False)]:
        for _ in range(5 if n > 60 else 20):
            base = rnd.choices(words, k=n)
            w = base[:]
            for k in rnd.sample(range(n), max(1, n // 4 if typos else n // 15)):
                w[k] = "x" + w[k][1:] if typos else rnd.choice(words)
            texts += [" ".join(base), " ".join(w)]
            if edit(*texts[-2:]) <= 0.1 * max(map(len, texts[-2:])) + 1e-9:
                pairs[n, typos].append(len(texts) - 1)
    out = {r.doc_id: r.n_removed for r in line_dedup.line_counts(docs_frame(spark, texts)).collect()}
    recall = {k: (sum(out[i] for i in v), len(v)) for k, v in pairs.items()}
    print("recall by (words, typos):", recall)
    assert len(recall) == 8 and all(found >= 0.9 * n for found, n in recall.values())


def test_line_passages(spark):
    """Lines that share a long passage: their keys are crowded, and copies meet by what is their own."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijklmnoprstuvw", k=rnd.randint(2, 9))) for _ in range(3000)]
    for shared, own, n in ((60, 14, 150), (40, 14, 150), (12, 6, 60)):
        passage, texts = rnd.choices(words, k=shared), []
        for _ in range(n):
            mine = rnd.choices(words, k=own)
            copy = mine[:]
            copy[rnd.randrange(own)] = rnd.choice(words)
            texts += [" ".join(passage + mine), " ".join(passage + copy)]
        wanted = [i for i in range(1, 2 * n, 2) if within(texts[i - 1], texts[i], int(0.1 * max(len(texts[i - 1]), len(texts[i])) + 1e-9))]
        out = {r.doc_id: r.n_removed for r in line_dedup.line_counts(docs_frame(spark, texts)).collect()}
        found = sum(out[i] for i in wanted)
        print(f"{shared} + {own} words: {found} of {len(wanted)}")
        assert len(wanted) > n / 2 and found >= 0.95 * len(wanted) and not any(out[i] for i in range(0, 2 * n, 2))


def test_line_links_are_whole(spark):
    """However crowded keys are, all similar lines of COMMON common keys are linked: groups equal those of all such pairs."""
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefghijklmnoprstuvw", k=rnd.randint(2, 9))) for _ in range(3000)]
    texts = []
    for shared, own, n in ((9, 3, 60), (30, 4, 40)):
        passage = rnd.choices(words, k=shared)
        for _ in range(n):
            mine = rnd.choices(words, k=own)
            copy = mine[:]
            k = rnd.randrange(own)
            copy[k] = copy[k][:-1] + "z"
            texts += [" ".join(passage + mine), " ".join(passage + copy)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", line_dedup.line_keys(F.col("t"), 0.9).alias("keys")).collect()
    keys, group = {r.i: set(r["keys"]) for r in rows}, list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            b, ws, vs = texts[j], set(a.split()), set(texts[j].split())
            near = len(keys[i] & keys[j]) >= line_dedup.COMMON and len(ws & vs) >= line_dedup.SHARED * max(len(ws), len(vs))
            if near and group[i] != group[j] and within(a, b, int(0.1 * max(len(a), len(b)) + 1e-9)):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    wanted = [int(group[i] != i) for i in range(len(texts))]
    for options in ({}, {"crowd": 3, "broadcast_bytes": 0, "broadcast_lines": 0}):
        out = {r.doc_id: r.n_removed for r in line_dedup.line_counts(docs_frame(spark, texts), **options).collect()}
        assert [out[i] for i in range(len(texts))] == wanted and 80 < sum(wanted) < len(texts)


def test_line_pairs_are_few(spark, monkeypatch):
    """Lines that share a passage but not their letters don't meet; near copies of one line are one group."""
    rnd, made = random.Random(17), {}
    words = ["".join(rnd.choices("abcdefghijklmnoprstuvw", k=rnd.randint(2, 9))) for _ in range(3000)]
    save = line_dedup.Scratch.save

    def saved(self, df, name):
        out = save(self, df, name)
        if name == "pairs-0":
            made["n"] = out.count()
        return out

    monkeypatch.setattr(line_dedup.Scratch, "save", saved)
    passage, base = rnd.choices(words, k=14), rnd.choices(words, k=60)
    texts = [" ".join(passage + rnd.choices(words, k=30)) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", line_dedup.line_keys(F.col("t"), 0.9).alias("keys")).collect()
    keys = {r.i: set(r["keys"]) for r in rows}
    near = [(i, j) for i in range(150) for j in range(i) if len(keys[i] & keys[j]) >= line_dedup.COMMON and min(len(texts[i]), len(texts[j])) >= 0.9 * max(len(texts[i]), len(texts[j]))]
    out = line_dedup.line_counts(docs_frame(spark, texts)).collect()
    assert len(near) > 2000 and made["n"] < len(near) / 10 and not any(r.n_removed for r in out)
    copies = [base]
    for _ in range(150):
        w = base[:]
        for k in rnd.sample(range(60), 4):
            w[k] = rnd.choice(words)
        copies.append(w)
    out = line_dedup.line_counts(docs_frame(spark, [" ".join(w) for w in copies])).collect()
    assert sum(r.n_removed for r in out) == 150


def test_line_lengths_meet(spark, monkeypatch):
    """Lines that share a passage but none of near length are not carried on from their keys; those of near length are."""
    rnd, met = random.Random(23), {}
    words = ["".join(rnd.choices("abcdefghijklmnoprstuvw", k=rnd.randint(2, 9))) for _ in range(3000)]
    save = line_dedup.Scratch.save

    def saved(self, df, name):
        out = save(self, df, name)
        if name in ("ordered", "texts"):
            met[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup.Scratch, "save", saved)
    passage, size, texts = rnd.choices(words, k=40), 20, []
    while len(texts) < 14:
        texts.append(" ".join(passage + rnd.choices(words, k=size)))
        size = round((size + 40) * 1.25) - 40
    out = line_dedup.line_counts(docs_frame(spark, texts)).collect()
    assert met == {"texts": 0, "ordered": 0} and not any(r.n_removed for r in out)
    out = {r.doc_id: r.n_removed for r in line_dedup.line_counts(docs_frame(spark, [*texts, f"{texts[3]} too"])).collect()}
    assert met["texts"] == 2 and [i for i in out if out[i]] == [14]


def test_line_scripts(spark):
    """Near copies are found in any script, and marks become spaces as one by one."""
    rnd = random.Random(29)
    for letters in ("абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπρ", "가나다라마바사아자차카타파하", "äöüßéèñóíç"):
        words, texts = ["".join(rnd.choices(letters, k=rnd.randint(2, 8))) for _ in range(300)], []
        for n in (9, 20, 60) * 3:
            w = rnd.choices(words, k=n)
            texts += [" ".join(w), " - ".join([*w[: n // 2], w[n // 2][:-1] + "x", *w[n // 2 + 1 :]])]
        out = {r.doc_id: r.n_removed for r in line_dedup.line_counts(docs_frame(spark, texts)).collect()}
        assert [out[i] for i in range(len(texts))] == [0, 1] * 9, letters
    odd = ["a-b  c", " -a", "a - b", "--", "a.\n. b", "a  ", "x\ty z", "ä–b_c"]
    rows = spark.createDataFrame([(x,) for x in odd], "t string").select(line_dedup.normal_lines(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["a b c"], ["a"], ["a b"], [""], ["a", "b"], ["a"], ["x y z"], ["ä–b c"]]


def test_token_counts(spark, texts):
    rnd = random.Random(2)
    pieces = sorted({"".join(rnd.choices("abc", k=rnd.randint(1, 4))) + rnd.choice(["", "</w>"]) for _ in range(60)} | {"a", "b", "a</w>", "b</w>"})

    def greedy(word, pieces, end):
        n, i = 0, 0
        while i < len(word):
            for j in range(len(word), i, -1):
                if (word[i:j] + (end if j == len(word) else "")) in pieces:
                    break
            else:
                return -1
            n, i = n + 1, j
        return n

    machine = token_counts.Automaton(pieces, end_mark="</w>")
    inner = token_counts.Automaton(["a", "ab", "##b", "##bc", "##a", "abcab"], continuation="##")

    def greedy2(word):
        known, n, i = {"a", "ab", "##b", "##bc", "##a", "abcab"}, 0, 0
        while i < len(word):
            for j in range(len(word), i, -1):
                if ("##" if i else "") + word[i:j] in known:
                    break
            else:
                return -1
            n, i = n + 1, j
        return n

    for _ in range(3000):
        w = "".join(rnd.choices("abc", k=rnd.randint(1, 12)))
        assert machine.count(w) == greedy(w, set(pieces), "</w>"), w
        assert inner.count(w) == greedy2(w), w
    import regex

    vocab, end = token_counts.vocabulary(tokenizer_path())
    known, visible = set(vocab), token_counts.byte_symbols()
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs_frame(spark, texts), vocab, end_mark=end, byte_level=True).collect()}
    for i, t in enumerate(texts):
        ws = regex.findall(token_counts.PATTERN, (t or "").lower())
        assert (rows[i].n_words, rows[i].n_tokens, rows[i].n_unknown) == (len(ws), sum(greedy("".join(visible[b] for b in w.encode()), known, end) for w in ws), 0)


def test_warc(spark, tmp_path):
    page = '<html lang="de"><head><title>A &amp; B</title><script>x</script></head><body><p>One<br>two &eacute;</p><!-- no --><a href="/x?a=1&amp;b">l</a></body></html>'
    rows = [(1, "http://a.de/", page, "2020-01-02T03:04:05Z", "HTTP/1.1 200 OK\r\nX: y", "<urn:uuid:1>"), (2, None, None, None, None, None), (3, "http://b.fr/\r\nX: forged", "", None, None, None), (3, "http://b.fr/\r\nX: forged", "", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, date string, headers string, rid string").withColumn("block", F.lit(1))
    made = warc.derive(pages, date_col="date", headers_col="headers", record_col="rid")
    rows = {(r.page_id, r.warc_type): r for r in made.collect()}
    assert len(rows) == 6 and made.count() == 8 and warc.derive(pages.limit(0)).count() == 0
    m, c = rows[1, "metadata"], rows[1, "conversion"]
    assert c.block == "A & B\nOne\ntwo é\nl" and m.refers_to == c.refers_to == "<urn:uuid:1>" and m.record_id != c.record_id
    assert "outlink: /x?a=1&b\r\n" in m.block and "declared-language: de\r\n" in m.block and "source-header: HTTP/1.1 200 OK\r\nsource-header: X: y\r\n" in m.block and "title: A & B\r\n" in m.block
    assert "WARC-Date: 2020-01-02T03:04:05Z" in c.header and "WARC-Refers-To-Date: 2020" in c.header and f"WARC-Date: {warc.EPOCH}" in rows[2, "conversion"].header
    assert c.content_length == len(c.block.encode()) and c.block_digest == warc.digest(c.block.encode()) and c.payload_digest == warc.digest(page.encode())
    assert rows[2, "conversion"].block == "" and rows[2, "conversion"].target_uri is None and "source-header" not in rows[2, "metadata"].block
    assert not any(x.startswith("X:") for x in rows[3, "metadata"].header.split("\r\n"))
    warc.write(made.repartition(1).orderBy("record_id"), str(tmp_path / "w"))
    import zlib as z

    seen = 0
    for f in (tmp_path / "w").glob("part-*"):
        raw = f.read_bytes()
        while raw:
            member = z.decompressobj(31)
            record, raw = member.decompress(raw), member.unused_data
            assert member.eof
            head, _, rest = record.partition(b"\r\n\r\n")
            n = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))[16:])
            assert rest[n:] == b"\r\n\r\n"
            seen += 1
    assert seen == 8


def test_warc_odd_tags():
    """Quoted `>`, names that only begin like an element's, unclosed quotes, an `html` in a comment."""
    read = warc.read_page
    assert read('<a title="a>b" href="/x">t</a>')[::3] == ("t", ["/x"])
    assert read("<a title='\"a>b' href=/x>t</a> it's <b>5 = 'x > y</b>")[::3] == ("t it's 5 = 'x > y", ["/x"])
    assert read("<script>x</scripty> y</script > z<style>a</style\n>b")[0] == "z b" and read("<script>x</script")[0] == ""
    assert read('<a x="1 href=/y>text <b>more</b>')[0] == "text more"
    assert read('<p it\'s>one</p><p>two\'s</p>')[0] == "one\ntwo's"
    assert warc.declared_language('<!-- <html lang="xx"> --><HTML class="a>b" lang=DE>') == "de"
    assert warc.declared_language("İ" * 40 + "<html lang=fr>") == "fr" and warc.declared_language("<p>") is None


def test_warc_against_parser():
    """Words of the text, links, title and language are those of the standard library's parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.raw, self.text, self.links, self.lang = 0, [], [], None

        def handle_starttag(self, tag, attrs):
            self.raw += tag in warc.RAW
            if tag in warc.BLOCKS:
                self.text.append(" ")
            if tag == "a" and not self.raw and dict(attrs).get("href") is not None:
                self.links.append(dict(attrs)["href"].strip())
            if tag == "html" and self.lang is None:
                self.lang = dict(attrs).get("lang")

        def handle_endtag(self, tag):
            self.raw -= tag in warc.RAW and self.raw > 0
            if tag in warc.BLOCKS:
                self.text.append(" ")

        def handle_data(self, data):
            if not self.raw:
                self.text.append(data)

    rnd = random.Random(11)
    parts = ['<a title="x>y" href="/q>r">', "<b class='>'>", "word", " ", "\n", "&amp;", "&eacute;t&eacute;", "<p>", "</p>", "<b>", "</b>", "<br>", "<script>if (1) { x = 'y' }</script>", "<style>p {}</style>", "<noscript>off</noscript>", "<!-- c <p> -->", "<a href='/x?y=1&amp;z'>", "</a>", '<A HREF="q" class=k>', "<li>", "é日", "<td>", "</td>"]
    for k in range(300):
        page = f'<html lang="{rnd.choice(["de", "en-US"])}"><body>' + "".join(rnd.choices(parts, k=rnd.randint(0, 40))) + "</body></html>"
        plain = Plain()
        plain.feed(page)
        plain.close()
        text, lang, _, links = warc.read_page(page)
        assert "".join(text.split()) == "".join("".join(plain.text).split()), page
        assert (lang, links) == (plain.lang, plain.links) and warc.declared_language(page) == plain.lang.lower()
    import time

    for bad in ('<a x="', "<a x='y\" ", "<a <a x=\">\"", "</scripty>", "<noscript>", "<a ", "<!--", "<script>", "<", "<html ", "<p <", "&", "<title>", "<a", "<a>" + "b" * 999_990):
        began = time.perf_counter()
        warc.read_page(bad * (1_000_000 // len(bad)))
        warc.read_page("<html " + bad[:1] * 500_000 + "x" * 500_000 + ">")
        assert time.perf_counter() - began < 8, bad


def test_ppm(spark):
    rnd = random.Random(4)
    syllables = ["ka", "lo", "mi", "ter", "un"]
    texts = [" ".join("".join(rnd.choices(syllables, k=rnd.randint(3, 6))) for _ in range(40)) for _ in range(150)] + [None, "", "Z" * 3000]
    rows = ppm.score(docs_frame(spark, texts), top=50).collect()
    train = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*(t or "").lower().split(), "\n"])
    n, v = train.total(), len(train)
    assert len(rows) == len(texts)
    for r in rows:
        tokens = [*(texts[r.doc_id] or "").lower().split(), "\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in train for w in tokens), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens))
    held = [r for r in rows if r.held_out]
    symbols = sum(len(texts[r.doc_id] or "") + 1 for r in held)
    assert sum(r.score for r in held) > -0.45 * symbols  # under 1.5 bits a byte; syllables alone have about 1
    assert ppm.score(docs_frame(spark, texts).limit(0)).count() == 0
    one = ppm.adaptive(docs_frame(spark, ["abababababababab", "qwertyuiopasdfgh", None])).orderBy("doc_id").collect()
    assert one[0].score > one[1].score and one[2].score == pytest.approx(-math.log10(258))


def plain_ppm(texts, ids):
    """log10 score of each text by plain PPM: symbols one by one, dicts of whole contexts."""
    deep, take = 5, 0.4
    symbols = [[256] * deep + [256 if b == 32 else b for b in b" ".join((t or "").encode().lower().split())] + [257] for t in texts]
    counts = collections.defaultdict(collections.Counter)
    for i, s in zip(ids, symbols, strict=True):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for k in range(deep, len(s)):
                counts[tuple(s[k - deep : k])][s[k]] += 1
    for depth in range(deep, 0, -1):
        for context, seen in [(c, s) for c, s in counts.items() if len(c) == depth]:
            for x in seen:
                counts[context[1:]][x] += 1

    def code(s, k):
        out, gone = 0.0, set()
        for depth in range(deep, -1, -1):
            if seen := {x: c for x, c in counts.get(tuple(s[k - depth : k]), {}).items() if x not in gone}:
                if s[k] in seen:
                    return out + math.log10((seen[s[k]] - take) / sum(seen.values()))
                out += math.log10(take * len(seen) / sum(seen.values()))
                gone |= seen.keys()
        return out - math.log10(258 - len(gone))

    return {i: sum(code(s, k) for k in range(deep, len(s))) for i, s in zip(ids, symbols, strict=True)}


def test_ppm_is_the_model_of_whole_texts(spark, monkeypatch):
    """Scores are those of plain PPM over whole texts with exact contexts, whatever is broadcast or priced at once."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choices(["ab", "abc", "cab", "d", "bêd"], k=12)) for _ in range(40)] + [None, "abzq", "Qx abcab " * 3]
    plain = pytest.approx(plain_ppm(texts, range(len(texts))))
    assert {r.doc_id: r.score for r in ppm.score(docs_frame(spark, texts)).collect()} == plain
    for name, size in (("PRICED", 5), ("READ_SYMBOLS", 300), ("KEPT_GRAMS", 200), ("TAKEN", 100)):
        monkeypatch.setattr(ppm, name, size)
    assert {r.doc_id: r.score for r in ppm.score(docs_frame(spark, texts), top=0, cache_grams=20).collect()} == plain


def test_ppm_without_training(spark):
    """With held-out documents only every symbol is uniform."""
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = ppm.score(spark.createDataFrame([(i, "ab c") for i in held], "doc_id long, text string")).collect()
    assert len(rows) == len(held) and all(r.score == pytest.approx(-5 * math.log10(258)) and r.n_known == r.train_tokens == 0 for r in rows)


def test_ppm_against_base(spark):
    """At sf0.001 scores are those of plain PPM; most training documents beat their base score."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = ppm.score(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = plain_ppm(texts.values(), texts)
    assert {r.doc_id: r.score for r in rows} == pytest.approx(plain)
    train = [r for r in rows if not r.held_out]
    assert sum(r.score > r.base_score for r in train) > len(train) / 2


def test_prices_are_a_distribution():
    """Probabilities of the next symbol add up to one under every context, with exclusion."""
    import numpy as np

    grams, of = ppm.grams_of(["abc abd bca a", "abcabd", "zz top", None])
    near = np.unique(ppm.parents(ppm.parents(grams)))
    levels = ppm.low_levels(*np.unique(ppm.parents(near), return_counts=True))
    seen, c = np.unique(grams, return_counts=True)
    for context in (grams[3] // ppm.A, grams[-2] // ppm.A, 7 * ppm.A**4 + 9, ppm.WORD * ppm.A**4):
        new = np.setdiff1d(context * ppm.A + np.arange(ppm.A), seen)
        every, counts = np.concatenate((seen, new)), np.concatenate((c, np.zeros(len(new), dtype=np.int64)))
        p = ppm.log10_prices(every, counts, levels)[every // ppm.A == context]
        assert len(p) == ppm.A and (10**p).sum() == pytest.approx(1)


def test_language(spark):
    rnd = random.Random(6)
    words = {"en": ["the", "and", "with", "that"], "de": ["und", "nicht", "über", "das"]}
    labelled = spark.createDataFrame([(" ".join(rnd.choices(words[k], k=30)), k) for k in words for _ in range(20)], "text string, lang string")
    page = lambda k, n: "<p>" + " ".join(rnd.choices(words[k], k=n)) + "</p>"
    rows = [(i, "http://h.example.de/", page("de", 30)) for i in range(9)] + [(20, "http://h.example.de/", "<p></p>"), (21, None, None), (22, "http://x.com/", '<html lang="en-US">' + page("en", 20)), (23, "http://x.com/", page("en", 50))]
    model = language_id.fit(labelled)
    out = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert len(out) == len(rows) and all(out[i].lang == "de" for i in [*range(9), 20]) and out[22].lang == out[23].lang == "en"
    assert out[20].text_lang is None and out[22].declared == "en"
    empty = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), language_id.fit(labelled.limit(0)))
    assert empty.where("lang is null").count() == len(rows)


def test_language_brute(spark):
    """Posteriors are those of a plain loop: own text, declaration, suffix, prior of the other pages of host, domain, all."""
    rnd = random.Random(13)
    words = {"en": ["the", "and", "with"], "de": ["und", "nicht", "das"], "fr": ["le", "et", "avec"]}
    labelled = spark.createDataFrame([(" ".join(rnd.choices(words[k], k=9)), k) for k in words for _ in range(9)], "text string, lang string")
    model = language_id.fit(labelled)
    hosts = ["http://a.co.uk/", "http://b.co.uk/x", "https://u@c.example.de:80/", "http://d.example.de", "no address", None]
    rows = [(k, rnd.choice(hosts), rnd.choice(["", '<html lang="FR-ca">', "<html lang=xx>"]) + "<p>" + " ".join(rnd.choices(words[rnd.choice(list(words))], k=rnd.randint(0, 4)))) for k in range(60)] + [(60, hosts[0], None), (1, hosts[1], "<p>the")]
    out = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()

    def soft(logs):
        whole = sum(math.exp(x) for x in logs)
        return [math.exp(x) / whole for x in logs]

    texts = [model.log_likelihood(warc.plain_text(h)).tolist() if h else [0.0] * 3 for _, _, h in rows]
    alone = [soft(x) for x in texts]
    host = [{hosts[0]: "a.co.uk", hosts[1]: "b.co.uk", hosts[2]: "c.example.de", hosts[3]: "d.example.de"}.get(u) for _, u, _ in rows]
    domain = [h and (h if h.endswith("uk") else "example.de") for h in host]
    wanted = []
    for k, (page, _, h) in enumerate(rows):
        prior = [1 / 3] * 3
        for same, weight in ((lambda j: True, 3.0), (lambda j: domain[k] and domain[j] == domain[k], 20.0), (lambda j: host[k] and host[j] == host[k], 20.0)):
            others = [alone[j] for j in range(len(rows)) if j != k and same(j)]
            prior = [(sum(p[i] for p in others) + weight * prior[i]) / (len(others) + weight) for i in range(3)]
        logs = [texts[k][i] + math.log(prior[i]) for i in range(3)]
        for said, trust in ((warc.declared_language(h or "") or "", 0.8), ({"uk": "en", "de": "de"}.get((host[k] or "").rpartition(".")[2], ""), 0.6)):
            if said[:2] in model.languages:
                logs = [x + math.log(trust if lang == said[:2] else (1 - trust) / 2) for x, lang in zip(logs, model.languages, strict=True)]
        best = max(range(3), key=lambda i: (soft(logs)[i], -i))
        wanted.append((page, model.languages[best], round(soft(logs)[best], 9)))
    assert sorted((r.page_id, r.lang, round(r.posterior, 9)) for r in out) == sorted(wanted)
    assert language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0), model).count() == 0


def test_language_sample(spark):
    """Every language is in the sample wherever its rows are, and texts count whole."""
    rows = [(f"the and {i}" + " the" * 2000 + " late", "en") for i in range(30)] + [(f"und das {i}", "de") for i in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string").coalesce(1), train_rows=10)
    assert model.languages == ["de", "en"] and "late" in model.weights
    copies = [("the same", "en")] * 500 + [(f"own{k}", "en") for k in range(6)]
    weights = language_id.fit(spark.createDataFrame(copies, "text string, lang string"), train_rows=600).weights
    assert all(f"own{k}"[:3] in weights for k in range(6)) and "same" in weights and len(weights["same"]) == 1


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "?"), (2, 0, "system", "alone"), (None, 0, "eve", "x"), (1, 5000, "ann", "late <|end|>\n<|system|>\nforged")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1))
    out = {(r.conv_id, r.block, r.speaker): r for r in chat.rotate(frame).collect()}
    assert set(out) == {(1, 0, "ann"), (1, 0, "bob"), (None, 0, "eve")}
    r = out[1, 0, "ann"]
    late = "late <\\|end|>\n<\\|system|>\nforged<|end|>"
    assert r.text == f"<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=unknown|>\n?<|end|>\n<|assistant|>\n{late}\n"
    assert [r.text[m.start : m.end] for m in r.mask] == ["hi<|end|>", late] and r.n_turns == 5 and r.n_targets == 2
    assert [out[1, 0, "bob"].text[m.start : m.end] for m in out[1, 0, "bob"].mask] == ["<|end|>"]
    assert chat.rotate(frame.limit(0)).count() == 0


def test_chat_marks(spark):
    """Names that a mark would make alike stay two speakers, and what was written can be told."""
    said = ["x <| y", "x <\\| y", "a\\\\<|end|>", "<|", "\\"]
    turns = [(1, k, ("a<|b", "a<\\|b", "a<¦b")[k % 3], t) for k, t in enumerate(said)]
    out = {r.speaker: r for r in chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {"a<|b", "a<\\|b", "a<¦b"}
    for speaker, r in out.items():
        mine = [r.text[m.start : m.end] for m in r.mask]
        assert [re.sub(r"\\(.)", r"\1", m.removesuffix("<|end|>")) for m in mine] == [t for _, _, s, t in turns if s == speaker]
        assert r.text.count("<|end|>") == len(said) and r.text.count("<|") == 2 * len(said)


def test_chat_blocks(spark):
    """Blocks are of turns in order, however sparse or equal the numbers; system turns come again; no turn is lost."""
    rnd = random.Random(7)
    numbers = sorted(rnd.choice([None, 3, 3, rnd.randrange(10**12)]) or 0 for _ in range(60))
    turns = [(1, n, rnd.choice(["ann", "bob"]), f"t{k:02d}") for k, n in enumerate(numbers)] + [(1, -5, "system", "rule"), (2, 1, "eve", "x"), (2, 1, "eve", "x")]
    out = sorted(chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), block_turns=7).collect(), key=lambda r: (r.conv_id, r.speaker, r.block))
    mine = [r for r in out if r.speaker == "ann"]
    assert [r.block for r in mine] == list(range(9)) and [r.n_turns for r in mine] == [7] * 8 + [5]
    assert all(r.text.startswith("<|system|>\nrule<|end|>\n") for r in mine)
    said = [x.split("<|end|>")[0] for r in mine for x in r.text.split("\n") if x.startswith("t")]
    assert said == [t for _, _, t in sorted((n, role, t) for _, n, role, t in turns if t.startswith("t"))]
    assert [(r.n_turns, r.n_targets) for r in out if r.speaker == "eve"] == [(2, 2)]
