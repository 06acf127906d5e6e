from pyspark.sql import functions as F

from lexigrain.operators import traces
from lexigrain.sources import files

SPECIAL = ["|", '"', ",", "\\", "null", "nan", "NA", "007", "é", "a b"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "variant string, step int, wall_ms double")


def test_nearest_percentile(spark):
    t = frame(spark, [("a", i, float(i)) for i in (1, 2, 3, 4)])
    assert traces.nearest(t, 0.5, "p").first().p == 3.0
    assert traces.medians(t).first().median_ms == 2.5


def test_rolling_and_cumulative(spark):
    t = frame(spark, [("a", i, float(i)) for i in range(1, 51)])
    got = {r.step: r.rolling for r in traces.rolling(t, 3).collect()}
    assert got[1] == 1.0 and got[2] == 1.5 and got[50] == 49.0
    share = {r.step: r.rolling for r in traces.rolling_share(t).collect()}
    assert share[1] == 1.0 and share[10] == 9.5
    assert max(r.cum_s for r in traces.cumulative(t).collect()) == 1.275


def test_without_baseline(spark):
    t = frame(spark, [("a", 1, 2.0)])
    assert traces.speedups(t, "Sequential").count() == 0
    assert traces.summary(t, "Sequential").first().speedup == 1.0
    assert tuple(traces.tiles(t, "Sequential").first()) == (1, 1, 1.0, "-")
    assert traces.scaling(spark.createDataFrame([(1, 2.0)], "n int, total_ms double")).count() == 0


def test_csv_round_trip(spark, tmp_path):
    rows = [(i, s, s, i, 1.5, None, None) for i, s in enumerate(SPECIAL)]
    path = str(tmp_path / "omp_2t.csv")
    files.write_csv(spark.createDataFrame(rows, files.TRACE), path)
    back = files.read_csv(spark, path).orderBy("step").collect()
    assert [r.pair_a for r in back] == SPECIAL and all(r.vocab_size is None for r in back)
    one = tmp_path / "all"
    one.mkdir()
    for name in ("seq_1.csv", "seq_2.csv", "cuda.csv"):
        (one / name).write_text(f'step,pair_a,pair_b,freq,wall_ms,vocab_size,avg_tok_len\n1,"{name}",b,2,3.0,,\n')
    got = {r.variant: r.pair_a for r in files.read_traces(spark, str(one)).collect()}
    assert got == {"Sequential": "seq_2.csv", "CUDA": "cuda.csv"}


def test_traces_as_written(spark, tmp_path):
    """read_traces reads what write_csv makes; of one label the last folder counts; a missing time is 0."""
    for name, value in (("seq_a", 1.0), ("seq_b", 2.0), ("omp_2t", None)):
        files.write_csv(spark.createDataFrame([(k, value) for k in (1, 2)], "step int, wall_ms double").repartition(2), str(tmp_path / f"{name}.csv"))
    got = files.read_traces(spark, str(tmp_path), "step int, wall_ms double")
    assert sorted((r.variant, r.step, r.wall_ms) for r in got.collect()) == [("OMP-2t", 1, None), ("OMP-2t", 2, None), ("Sequential", 1, 2.0), ("Sequential", 2, 2.0)]
    assert {r.variant: (r.total_ms, r.p50) for r in traces.summary(got, "Sequential").collect()} == {"OMP-2t": (0.0, 0.0), "Sequential": (4.0, 2.0)}
    files.write_json(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), "a int, b string").first() == (1, "x")


def test_numbered(spark):
    rows = [(f"w{k}", k % 7) for k in range(500)]
    got = traces.numbered(spark.createDataFrame(rows, "word string, freq int").repartition(5), F.desc("freq"), F.asc("word")).collect()
    assert [r.word for r in sorted(got, key=lambda r: r.step)] == [w for w, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(r.step for r in got) == list(range(1, 501))
    assert traces.numbered(spark.createDataFrame([], "word string, freq int"), F.asc("word")).count() == 0


def test_sources(spark, tmp_path):
    assert files.demo_corpus(spark, 5).select(F.size(F.split("text", " ")).alias("n")).first().n == 20
    assert files.demo_traces(spark).count() == 1800
    (tmp_path / "a.txt").write_text("x y\nz")
    assert files.read_corpus(spark, str(tmp_path / "none.txt"), str(tmp_path / "a.txt")).first().text == "x y\nz"
    assert files.read_corpus(spark, str(tmp_path / "none.txt")) is None


def test_replace_and_heatmaps(spark):
    t = frame(spark, [("a", 1, 1.0), ("b", 1, 2.0)])
    assert {(r.variant, r.wall_ms) for r in traces.replace_variants(t, frame(spark, [("b", 1, 9.0)])).collect()} == {("a", 1.0), ("b", 9.0)}
    m = spark.createDataFrame([(i, "a", "b" * (i % 3 + 1), 10 * i) for i in range(1, 21)], "step int, pair_a string, pair_b string, freq int")
    assert {r.bin for r in traces.heatmap_cut(m).collect()} == set(range(10))
    assert traces.heatmap_cut(m.limit(1)).first().bin == 0
    assert traces.heatmap_grid(traces.heatmap_floor(m), [2, 3, 4]).count() == 10


def test_demo_steps_beyond_int(spark):
    steps = [10_737, 10_738, 357_913_941, 2_147_483_647]
    made = {(r.variant, r.step): r for r in files.demo_steps(spark.createDataFrame([(s,) for s in steps], "step bigint")).collect()}
    assert len(made) == 6 * len(steps)
    for k, (variant, base, scale) in enumerate(files.DEMO_VARIANTS):
        for step in steps:
            x = (step * 6 + k) % 2147483647
            for _ in range(3):
                x = (x * 48271 + 42 * 40692 + 11) % 2147483647
            base, percent = int(base), round(scale * 100)
            wall = max(10_000_000, base * percent * 100_000 + x % 1_000_000 * base * 3 - base * 1_500_000 + step * 200_000)
            assert made[variant, step].wall_ms == (wall + 5_000) // 10_000 / 1000
            assert made[variant, step].vocab_size == (None if k else int(250.5 + 198 + 0.5 * (step - 149)))


def test_labels_follow_files_not_rows(spark, tmp_path, monkeypatch):
    calls, label = spark.sparkContext.accumulator(0), files.variant_label

    def counted(name):
        seen = F.udf(lambda s: (calls.add(1), s)[1], "string").asNondeterministic()
        return label(seen(name))

    for folder, wall in (("a", 0.0), ("b", 2.0)):
        for name in ("seq_results", "omp_2t"):
            files.write_csv(spark.range(500).select("id", F.lit(wall).alias("wall")), str(tmp_path / folder / f"{name}.csv"))
    monkeypatch.setattr(files, "variant_label", counted)
    got = files.read_traces(spark, str(tmp_path), "id bigint, wall double")
    assert got.columns == ["variant", "id", "wall"]
    assert {tuple(r) for r in got.groupBy("variant", "wall").count().collect()} == {("Sequential", 2.0, 500), ("OMP-2t", 2.0, 500)}
    assert calls.value < 500
