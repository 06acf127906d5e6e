import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_every_reference_query_has_sql():
    from lexigrain.plans import catalog

    assert catalog.QUERIES.keys() == catalog.ORACLES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_streaming_word_count(spark, tmp_path):
    from lexigrain.streaming.words import running_word_count

    (tmp_path / "a.txt").write_text("x y x\n")
    q = running_word_count(spark.readStream.text(str(tmp_path)), "value").writeStream.outputMode("complete").format("memory").queryName("words_so_far").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("words_so_far").collect()} == {("x", 2), ("y", 1)}
