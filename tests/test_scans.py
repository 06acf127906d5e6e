"""Groups over many tasks: order statistics, running totals, windows; kept counts; long lines."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexigrain.operators import scans, selection, traces, words
from lexigrain.operators.word_store import WordStore
from lexigrain.sources import files


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "variant string, step int, wall_ms double").repartition(parts)


@pytest.fixture(scope="module")
def rows():
    """One variant with nearly all rows, one whose values are mostly one, one with few."""
    rnd = random.Random(2)
    out = [("big", k, rnd.lognormvariate(0, 3)) for k in range(3000)] + [("same", k, 5.0 if rnd.random() < 0.9 else rnd.random() * 10) for k in range(500)]
    return out + [("few", 1, 2.0), ("few", 2, None), ("few", 3, -1.5), ("one", 1, 7.25), ("none", 1, None)]


@pytest.mark.parametrize("few", [10_000, 20])
def test_places_by_passes(spark, rows, few, monkeypatch):
    """Small ranges at once, or pass after pass: the same values as sorting."""
    t = frame(spark, rows)
    by = {}
    for v, _, x in rows:
        if x is not None:
            by.setdefault(v, []).append(x)
    for v in by.values():
        v.sort()
    wanted = spark.createDataFrame([(v, f"p{k}", k) for v in ("big", "same", "few", "one", "none") for k in (0, 1, 250, 499, 1500, 2999, 3000, -1)], "variant string, name string, place bigint")
    got = {(r.variant, r.name): r.wall_ms for r in selection.select_places(t, wanted, "variant", "wall_ms", few).collect()}
    assert got == {(v, f"p{k}"): by[v][k] for v in by for k in (0, 1, 250, 499, 1500, 2999) if k < len(by[v])}
    middle = {r.variant: r.median for r in selection.medians(t, "variant", "wall_ms", few).collect()}
    assert middle == {v: x[(len(x) - 1) // 2] * 0.5 + x[len(x) // 2] * 0.5 for v, x in by.items()}
    assert selection.select_places(t.limit(0), wanted, "variant", "wall_ms").count() == 0


def test_percentiles(spark, rows):
    got = {r.variant: (r.p50, r.p95) for r in traces.percentiles(frame(spark, rows), p50=0.5, p95=0.95).collect()}
    for v in got:
        x = sorted(y or 0.0 for w, _, y in rows if w == v)
        assert got[v] == (x[min(len(x) // 2, len(x) - 1)], x[min(int(len(x) * 0.95), len(x) - 1)])
    assert traces.medians(frame(spark, rows)).where("variant = 'none'").first().median_ms is None


def test_no_task_holds_a_variant(spark, rows):
    t = traces.in_steps(frame(spark, rows))
    sizes = t.where("variant = 'big'").groupBy("__block").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 3000
    for made in (traces.cumulative(frame(spark, rows)), traces.rolling(frame(spark, rows))):
        plan = made._jdf.queryExecution().toString()
        windows = [line for line in plan.split("\n") if " Window [" in line and "sum(" in line]
        assert windows and all("__block" in line for line in windows)


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_windows_over_blocks(spark, rows, parts):
    """Blocks larger and smaller than the window, down to single rows."""
    some = [r for r in rows if r[0] != "big" or r[1] < 60]
    placed = scans.blocks(frame(spark, some), ["variant"], [F.col("step")], parts)
    exact = F.coalesce(F.col("wall_ms"), F.lit(0.0)).cast("decimal(18,6)")
    made = scans.running(placed, ["variant"], exact, "total")
    total = {(r.variant, r.step): (r.total, r["__n"]) for r in made.collect()}
    last = scans.last_rows(placed, ["variant"], 7, seen=lambda w: F.collect_list("step").over(w), n=lambda w: F.count("wall_ms").over(w))
    seen = {(r.variant, r.step): (r.seen, r.n) for r in last.collect()}
    assert len(seen) == last.count() == len(some)
    for v in {r[0] for r in some}:
        mine = sorted(r[1:] for r in some if r[0] == v)
        for i, (step, _) in enumerate(mine):
            assert total[v, step] == (sum((Decimal(str(round(x or 0.0, 6))).quantize(Decimal("0.000001")) for _, x in mine[: i + 1]), Decimal(0)), i + 1)
            window = mine[max(0, i - 6) : i + 1]
            assert seen[v, step] == ([s for s, _ in window], sum(x is not None for _, x in window))


def test_numbered_in_groups(spark):
    rows = [(None if k % 5 == 0 else f"g{k % 3}", k) for k in range(200)]
    got = scans.numbered(spark.createDataFrame(rows, "g string, k int").repartition(6), [F.desc("k")], "place", ["g"], parts=9)
    assert got.columns == ["g", "k", "place"]
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in got.collect() if r.g == g), key=lambda r: r.place)
        assert [r.k for r in mine] == sorted((k for h, k in rows if h == g), reverse=True) and [r.place for r in mine] == list(range(1, len(mine) + 1))


def test_kept_counts(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"the w{k % 4} the") for k in range(20)] + [(99, None)], "doc_id long, text string")
    whole = {tuple(r) for r in words.word_count(docs).collect()}
    store = WordStore(spark, str(tmp_path / "counts"))
    store.add("even", docs.where("doc_id % 2 = 0"))
    store.add("odd", docs.where("doc_id % 2 = 1"))
    store.add("odd", docs.where("doc_id % 2 = 1"))  # counted again, it counts once
    assert {tuple(r) for r in store.counts().collect()} == whole
    assert {tuple(r) for r in store.counts("odd").collect()} == {tuple(r) for r in words.word_count(docs.where("doc_id % 2 = 1")).collect()}
    again = WordStore(spark, str(tmp_path / "counts"))
    assert again.sets() == ["even", "odd"]
    again.fold("all", "even", "odd")
    again.add("new", spark.createDataFrame([("x the",)], "text string"))
    assert again.sets() == ["all", "new"] and {r.word: r.freq for r in WordStore(spark, str(tmp_path / "counts")).counts().collect()} == dict(whole) | {"the": 41, "x": 1}
    tables = [p for p in (tmp_path / "counts").iterdir() if p.name.startswith("counts-")]
    assert len(tables) == 2
    again.remove("all", "new")
    assert again.counts().count() == 0


def test_one_long_line(spark, tmp_path):
    """One line of 6 MB is dealt to several tasks, and no word is cut."""
    rnd = random.Random(3)
    vocabulary = [f"wörd{k}" for k in range(500)] + ["x" * 150]
    picked = rnd.choices(vocabulary, k=700_000)
    (tmp_path / "line.txt").write_text("\t".join(picked[:1000]) + " " + " ".join(picked[1000:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        read = files.read_stretches(spark, str(tmp_path / "line.txt"))
        assert read.rdd.getNumPartitions() >= 5
        plain = spark.read.text(str(tmp_path / "line.txt")).withColumnRenamed("value", "text")
        assert {tuple(r) for r in words.word_count(read).collect()} == {tuple(r) for r in words.word_count(plain).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError):
        files.read_stretches(spark, "x", "ab")


def test_upper_case_ending(spark, tmp_path):
    (tmp_path / "SEQ.CSV").write_text("step,wall_ms\n1,3.0\n")
    got = files.read_traces(spark, str(tmp_path), "step int, wall_ms double").collect()
    assert [(r.variant, r.wall_ms) for r in got] == [("Sequential", 3.0)]
    assert words.measured_throughput(spark.createDataFrame([("a b a",)], "text string")).first().total_tokens == 3
