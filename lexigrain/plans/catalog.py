"""The registered queries over whole tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import text as T
from lexigrain.functions.ranks import encode_words
from lexigrain.operators import bpe, engines, scans, traces, words
from lexigrain.operators.bpe_index import Training
from lexigrain.operators.shared import Folder
from lexigrain.operators.word_store import WordStore
from lexigrain.sources import files

MERGES = 10
MANY = 50
BASELINE = "click"
SAMPLE = ("the", "of", "and", "to", "in", "is", "that", "it")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_count(table(spark, sf_dir, "documents"))


_counts: dict[tuple[str, str], DataFrame] = {}
_trainings: dict[tuple[str, str, int], Training] = {}
_vocabularies: dict[tuple[str, str, int], DataFrame] = {}


def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, made once a session and folder, for what reads them more than once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _counts:
        _counts[key] = Folder(spark).save(counts(spark, sf_dir), "counts")
    return _counts[key]


def trained(spark: SparkSession, sf_dir: str, merges: int = MERGES) -> Training:
    """A training over the documents, run once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, merges)
    if key not in _trainings:
        training = Training(kept_counts(spark, sf_dir), stats=merges == MANY)
        training.run(merges)
        _trainings[key] = training
    return _trainings[key]


def vocabulary(spark: SparkSession, sf_dir: str, merges: int = MERGES) -> DataFrame:
    """(word, freq, s) after the merges, s the wrapped symbols."""
    key = (spark.sparkContext.applicationId, sf_dir, merges)
    if key not in _vocabularies:
        wrapped = F.concat(F.lit(T.OPEN), F.array_join("tokens", T.CLOSE + T.OPEN), F.lit(T.CLOSE))
        encoded = encode_words(kept_counts(spark, sf_dir), rules(spark, sf_dir, merges))
        _vocabularies[key] = Folder(spark).save(encoded.select("word", "freq", wrapped.alias("s")), "vocabulary")
    return _vocabularies[key]


def rules(spark: SparkSession, sf_dir: str, merges: int = MERGES) -> list[bpe.Merge]:
    return trained(spark, sf_dir, merges).merges


def merge_table(spark: SparkSession, sf_dir: str, merges: int = MERGES) -> DataFrame:
    return spark.createDataFrame([tuple(r[:4]) for r in trained(spark, sf_dir, merges).state["trace"]], "step int, pair_a string, pair_b string, freq bigint")


_traces: dict[tuple[str, str], DataFrame] = {}


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a trace: variant event_type, step by event_id, wall_ms value; numbered once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _traces:
        e = table(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), "event_id", F.col("value").alias("wall_ms"))
        numbered = scans.numbered(e, [F.col("event_id")], "step", ["variant"])
        _traces[key] = Folder(spark).save(numbered.select("variant", F.col("step").cast("int").alias("step"), "wall_ms", "event_id"), "trace")
    return _traces[key]


# --- SQL pieces
TOK = r"regexp_extract_all({}, '[^\x20\x09-\x0D]{{1,99}}')"
W = f"w AS (SELECT word, count(*) AS freq FROM (SELECT unnest({TOK.format('text')}) AS word FROM documents) GROUP BY word)"
ARR = "string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1))"
WRAP = "chr(1) || array_to_string(list_concat(string_split({0}, ''), ['</w>']), chr(2) || chr(1)) || chr(2)"
EVENTS = "t AS (SELECT event_type AS variant, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step, value AS wall_ms, CAST(value AS DECIMAL(18, 6)) AS wall, event_id FROM events)"
TOTALS = "s AS (SELECT variant, count(*) AS steps, CAST(sum(wall) AS DOUBLE) AS total_ms FROM t GROUP BY variant)"


def pairs_sql(vocab: str) -> str:
    return f"SELECT a[i] AS l, a[i + 1] AS r, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT freq, a, unnest(range(1, len(a))) AS i FROM (SELECT freq, {ARR} AS a FROM {vocab})) GROUP BY 1, 2"


def replay(s: str, k: str) -> str:
    return f"replace({s}, chr(1) || b{k}.l || chr(2) || chr(1) || b{k}.r || chr(2), chr(1) || b{k}.l || b{k}.r || chr(2))"


def training_sql(merges: int = MERGES) -> str:
    parts = [W, f"v0 AS MATERIALIZED (SELECT word, freq, {WRAP.format('word')} AS s FROM w)"]
    for k in range(1, merges + 1):
        parts.append(f"b{k} AS MATERIALIZED (SELECT {k} AS step, l, r, freq FROM ({pairs_sql(f'v{k - 1}')}) ORDER BY freq DESC, l, r LIMIT 1)")
        parts.append(f"v{k} AS MATERIALIZED (SELECT word, v.freq, {replay('s', str(k))} AS s FROM v{k - 1} v, b{k})")
    parts.append("m AS (" + " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(1, merges + 1)) + ")")
    return "WITH " + ", ".join(parts)


def encode_sql(word: str, merges: int = MERGES) -> str:
    s = WRAP.format(word)
    for k in range(1, merges + 1):
        s = replay(s, str(k))
    return s


def rules_from(merges: int = MERGES) -> str:
    return ", ".join(f"b{k}" for k in range(1, merges + 1))


TRAIN = training_sql()
SHOW = "replace(substr({0}, 2, length({0}) - 2), chr(2) || chr(1), ' ')"
TRAIN_MANY = training_sql(MANY)
N_SYMBOLS = "(length({0}) - length(replace({0}, chr(1), '')))"


# --- words
@query(f"WITH {W} SELECT word, freq FROM w")
def word_count(spark, sf_dir):
    return counts(spark, sf_dir)


@query(f"WITH {W} SELECT CAST(sum(freq) AS BIGINT) AS total_tokens, count(*) AS unique_tokens FROM w")
def word_totals(spark, sf_dir):
    return words.totals(counts(spark, sf_dir))


@query(f"WITH {W} SELECT word, freq FROM w ORDER BY freq DESC, word LIMIT 20")
def top_words(spark, sf_dir):
    return words.top_words(counts(spark, sf_dir), 20)


@query(f"WITH {W} SELECT CAST(sum(freq) AS BIGINT) AS total_tokens, count(*) AS unique_tokens, CAST(sum(freq) AS DOUBLE) / 2.0 AS tokens_per_second FROM w")
def word_throughput(spark, sf_dir):
    return words.throughput(counts(spark, sf_dir), 2.0)


@query(f"""SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars,
 (SELECT count(*) FROM (SELECT unnest({TOK.format('text')}) FROM documents)) AS tokens,
 (SELECT count(DISTINCT x) FROM (SELECT unnest({TOK.format('text')}) AS x FROM documents)) AS unique_words,
 (SELECT count(DISTINCT c) FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '') AS unique_chars FROM documents""")
def corpus_stats(spark, sf_dir):
    return words.corpus_stats(table(spark, sf_dir, "documents"))


@query(f"""WITH a AS (SELECT lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang),
 b AS (SELECT lang, count(*) AS tokens, count(DISTINCT x) AS unique_words FROM (SELECT lang, unnest({TOK.format('text')}) AS x FROM documents) GROUP BY lang),
 c AS (SELECT lang, count(DISTINCT c) AS unique_chars FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY lang)
 SELECT documents, chars, tokens, unique_words, unique_chars, lang FROM a JOIN b USING (lang) JOIN c USING (lang)""")
def corpus_stats_by_lang(spark, sf_dir):
    return words.corpus_stats(table(spark, sf_dir, "documents"), "text", "lang")


@query("SELECT word, count(*) AS freq FROM (SELECT lower(unnest(regexp_extract_all(html, '[A-Za-z<>_-]+'))) AS word FROM pages) GROUP BY word")
def alpha_lower_count(spark, sf_dir):
    return words.word_count(table(spark, sf_dir, "pages"), "html", T.alpha_lower_tokens)


@query(f"""WITH {W}, h AS (SELECT list_reduce(list_prepend(CAST(5381 AS HUGEINT), [CAST(('0x' || b) AS HUGEINT) FOR b IN regexp_extract_all(hex(encode(word)), '..')]), lambda h, b: (h * 33 + b) % 18446744073709551616) % 100003 AS bucket FROM w),
 c AS (SELECT bucket, count(*) AS chain FROM h GROUP BY bucket)
 SELECT CAST(sum(chain) AS BIGINT) AS words, max(chain) AS max_chain, 100003 - count(*) AS empty_buckets, CAST(sum(chain) AS DOUBLE) / 100003.0::DOUBLE AS load_factor, (100003 - count(*)) * 100.0::DOUBLE / 100003 AS empty_percent FROM c""")
def bucket_health(spark, sf_dir):
    return words.bucket_health(counts(spark, sf_dir))


@query(f"WITH {W} SELECT word, {SHOW.format('s')} AS symbols FROM (SELECT word, {WRAP.format('word')} AS s FROM w)")
def char_symbols(spark, sf_dir):
    return counts(spark, sf_dir).select("word", F.array_join(T.symbols(F.col("word")), " ").alias("symbols"))


@query(f"WITH {W} SELECT word, freq FROM w")
def word_count_merged(spark, sf_dir):
    """Counts of three sets of documents, two of them folded into one, together those of all."""
    store, docs = WordStore(spark), table(spark, sf_dir, "documents")
    for k in range(3):
        store.add(f"part{k}", docs.where(F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)) == k))
    store.fold("old", "part0", "part1")
    return store.counts()


@query(f"WITH {W} SELECT word, freq FROM w")
def long_line_word_count(spark, sf_dir):
    """Documents written as files of one line each, and read in stretches of it."""
    path = _out(spark)
    flat = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    table(spark, sf_dir, "documents").select(flat.alias("text")).where("text is not null").write.option("lineSep", " ").text(path)
    return words.word_count(files.read_stretches(spark, path))


@query(f"WITH {W} SELECT CAST(sum(freq) AS BIGINT) AS total_tokens, count(*) AS unique_tokens, true AS timed FROM w")
def word_throughput_measured(spark, sf_dir):
    made = words.measured_throughput(table(spark, sf_dir, "documents"))
    consistent = F.abs(F.col("tokens_per_second") * F.col("seconds") - F.col("total_tokens")) < 1
    return made.select("total_tokens", "unique_tokens", ((F.col("seconds") > 0) & consistent).alias("timed"))


# --- byte pair encoding
@query(f"WITH {W}, v0 AS (SELECT freq, {WRAP.format('word')} AS s FROM w) SELECT l AS \"left\", r AS \"right\", freq FROM ({pairs_sql('v0')})")
def pair_counts(spark, sf_dir):
    return bpe.pair_counts(bpe.vocabulary(counts(spark, sf_dir)))


@query(f"WITH {W}, v0 AS (SELECT freq, {WRAP.format('word')} AS s FROM w) SELECT l AS \"left\", r AS \"right\", freq FROM ({pairs_sql('v0')}) ORDER BY freq DESC, l, r LIMIT 1")
def best_pair(spark, sf_dir):
    return bpe.best_pair(bpe.pair_counts(bpe.vocabulary(counts(spark, sf_dir))))


@query(f"WITH {W}, b0 AS (SELECT 'e' AS l, 'r' AS r), v AS (SELECT word, freq, {replay(WRAP.format('word'), '0')} AS s FROM w, b0) SELECT word, freq, {SHOW.format('s')} AS symbols FROM v")
def single_merge_er(spark, sf_dir):
    vocab = bpe.merge_pair(bpe.vocabulary(counts(spark, sf_dir)), "e", "r")
    return vocab.select("word", "freq", F.array_join(T.unwrapped(F.col("s")), " ").alias("symbols"))


@query(f"{TRAIN} SELECT step, l AS pair_a, r AS pair_b, freq FROM m")
def bpe_train_10(spark, sf_dir):
    return merge_table(spark, sf_dir)


@query(f"{TRAIN_MANY} SELECT step, l AS pair_a, r AS pair_b, freq FROM m")
def bpe_train_50(spark, sf_dir):
    return merge_table(spark, sf_dir, MANY)


@query(f"{TRAIN} SELECT step, l AS pair_a, r AS pair_b, freq FROM m")
def bpe_train_resumed(spark, sf_dir):
    path = _out(spark)
    Training(counts(spark, sf_dir), path).run(MERGES // 2)
    nothing = spark.createDataFrame([], "word string, freq bigint")  # what the state needs is in the folder
    return Training(nothing, path).run(MERGES).select("step", "pair_a", "pair_b", "freq")


@query(f"{TRAIN_MANY} SELECT word, {SHOW.format('s')} AS tokens FROM v{MANY}")
def bpe_rank_encode_50(spark, sf_dir):
    encoded = encode_words(kept_counts(spark, sf_dir), rules(spark, sf_dir, MANY))
    return encoded.select("word", F.array_join("tokens", " ").alias("tokens"))


def stats_sql(merges: int) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS step, count(DISTINCT x) AS vocab_size, CAST(sum(strlen(x)) AS DOUBLE) / count(*) AS avg_tok_len FROM (SELECT unnest({ARR}) AS x FROM v{k})" for k in range(1, merges + 1))


_STATS = stats_sql(3)


@query(f"{TRAIN_MANY}, st AS ({stats_sql(MANY)}) SELECT step, l AS pair_a, r AS pair_b, freq, vocab_size, round(avg_tok_len, 9) AS avg_tok_len FROM m JOIN st USING (step)")
def bpe_trace_stats_50(spark, sf_dir):
    rows = [(*r[:4], r[5], round(r[6], 9)) for r in trained(spark, sf_dir, MANY).state["trace"]]
    return spark.createDataFrame(rows, "step int, pair_a string, pair_b string, freq bigint, vocab_size bigint, avg_tok_len double")


@query(f"{training_sql(3)}, st AS ({_STATS}) SELECT step, l AS pair_a, r AS pair_b, freq, vocab_size, round(avg_tok_len, 9) AS avg_tok_len FROM m JOIN st USING (step)")
def bpe_trace_stats(spark, sf_dir):
    trace = Training(counts(spark, sf_dir), stats=True).run(3)
    return trace.select("step", "pair_a", "pair_b", "freq", "vocab_size", F.round("avg_tok_len", 9).alias("avg_tok_len"))


@query(f"{TRAIN}, e AS (SELECT freq, {N_SYMBOLS.format('s')} AS n FROM v{MERGES}) SELECT CAST(sum(freq) AS BIGINT) AS words, CAST(sum(freq * n) AS BIGINT) AS subwords, CAST(sum(freq * n) AS DOUBLE) / sum(freq) AS subwords_per_word FROM e")
def bpe_totals(spark, sf_dir):
    vocab = vocabulary(spark, sf_dir)
    return bpe.encoded_totals(vocab.select("word", "freq"), vocab.select("word", T.unwrapped(F.col("s")).alias("tokens")))


@query(f"{TRAIN} SELECT count(DISTINCT x) AS vocab_size, round(CAST(sum(strlen(x)) AS DOUBLE) / count(*), 9) AS avg_tok_len FROM (SELECT unnest({ARR}) AS x FROM v{MERGES})")
def bpe_symbol_stats(spark, sf_dir):
    return bpe.symbol_stats(vocabulary(spark, sf_dir)).select("vocab_size", F.round("avg_tok_len", 9).alias("avg_tok_len"))


@query(f"{TRAIN} SELECT word, {SHOW.format('s')} AS tokens FROM v{MERGES}")
def bpe_encode_vocab(spark, sf_dir):
    return bpe.encode_distinct(kept_counts(spark, sf_dir), rules(spark, sf_dir)).select("word", F.array_join("tokens", " ").alias("tokens"))


_BENCH = f"u AS (SELECT DISTINCT unnest({TOK.format('text')}) AS word FROM benchmark)"


@query(f"{TRAIN}, {_BENCH}, e AS (SELECT word, {encode_sql('word')} AS s FROM u, {rules_from()}) SELECT word, {SHOW.format('s')} AS tokens FROM e")
def bpe_encode_benchmark(spark, sf_dir):
    return bpe.encode_distinct(words.tokens(table(spark, sf_dir, "benchmark")), rules(spark, sf_dir)).select("word", F.array_join("tokens", " ").alias("tokens"))


def _shots_sql() -> str:
    states = [WRAP.format("word")]
    for k in range(1, MERGES + 1):
        states.append(replay(states[-1], str(k)))
    shots = " UNION ALL ".join(f"SELECT word, {k} AS k, {s} AS s FROM u{', ' + rules_from(k) if k else ''}" for k, s in enumerate(states))
    return f"{TRAIN}, {_BENCH}, x AS ({shots}), y AS (SELECT *, lag(s) OVER (PARTITION BY word ORDER BY k) AS p FROM x) SELECT word, string_agg({SHOW.format('s')}, ' > ' ORDER BY k) AS shots FROM y WHERE p IS NULL OR p <> s GROUP BY word"


@query(_shots_sql())
def bpe_encode_trace(spark, sf_dir):
    shots = bpe.encode_trace(F.col("word"), rules(spark, sf_dir))
    made = words.tokens(table(spark, sf_dir, "benchmark")).select("word").distinct().withColumn("shots", shots)
    return made.select("word", F.array_join(F.transform("shots", lambda x: F.array_join(x, " ")), " > ").alias("shots"))


@query(f"{TRAIN}, {_BENCH}, e AS (SELECT word, {encode_sql('word', 4)} AS s FROM u, {rules_from(4)}) SELECT word, {SHOW.format('s')} AS tokens FROM e")
def bpe_partial_encode(spark, sf_dir):
    return bpe.encode_distinct(words.tokens(table(spark, sf_dir, "benchmark")), rules(spark, sf_dir)[:4]).select("word", F.array_join("tokens", " ").alias("tokens"))


@query(f"{TRAIN}, q AS (SELECT word, count(*) AS freq FROM (SELECT unnest({TOK.format('text')}) AS word FROM benchmark) GROUP BY word) SELECT word, q.freq, CAST(coalesce({N_SYMBOLS.format('s')}, 0) AS BIGINT) AS n_symbols FROM q LEFT JOIN v{MERGES} USING (word)")
def bpe_lookup_left_join(spark, sf_dir):
    vocab = vocabulary(spark, sf_dir).withColumn("n_symbols", T.symbol_count(F.col("s")).cast("bigint"))
    return words.lookup(words.word_count(table(spark, sf_dir, "benchmark")), vocab, "n_symbols", F.lit(0))


_LIST = ", ".join(f"('{w}')" for w in SAMPLE)


@query(f"{TRAIN} SELECT x.word, coalesce({SHOW.format('s')}, 'not found') AS tokens FROM (VALUES {_LIST}) x(word) LEFT JOIN v{MERGES} USING (word)")
def bpe_sample_words(spark, sf_dir):
    vocab = vocabulary(spark, sf_dir).withColumn("tokens", F.array_join(T.unwrapped(F.col("s")), " "))
    return words.lookup(spark.createDataFrame([(w,) for w in SAMPLE], "word string"), vocab, "tokens", F.lit("not found"))


@query(f"""{TRAIN}, q AS (SELECT conv_id, turn, unnest({TOK.format('text')}) AS word FROM conversations), u AS (SELECT DISTINCT word FROM q),
 e AS (SELECT word, {encode_sql('word')} AS s FROM u, {rules_from()})
 SELECT conv_id, turn, count(*) AS words, CAST(sum({N_SYMBOLS.format('s')}) AS BIGINT) AS tokens, CAST(sum({N_SYMBOLS.format('s')} - CAST(right(s, 6) = chr(1) || '</w>' || chr(2) AS INT)) AS BIGINT) AS shown FROM q JOIN e USING (word) GROUP BY conv_id, turn""")
def sentence_token_counts(spark, sf_dir):
    tokens = words.tokens(table(spark, sf_dir, "conversations"), "text", T.whitespace_tokens, "conv_id", "turn")
    encoded = bpe.encode_distinct(tokens, rules(spark, sf_dir)).select("word", F.size("tokens").alias("n"), F.size(bpe.without_marker(F.col("tokens"))).alias("m"))
    per_word = tokens.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("k"))
    return per_word.join(encoded, "word").groupBy("conv_id", "turn").agg(F.sum("k").alias("words"), F.sum(F.col("k") * F.col("n")).alias("tokens"), F.sum(F.col("k") * F.col("m")).alias("shown"))


# --- traces
@query(f"WITH {EVENTS} SELECT variant, step, round(CAST(sum(wall) OVER (PARTITION BY variant ORDER BY step) AS DOUBLE) / 1000, 6) AS cum_s FROM t")
def trace_cumulative(spark, sf_dir):
    return traces.cumulative(event_trace(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT variant, step, round(CAST(sum(wall) OVER x AS DOUBLE) / count(*) OVER x, 6) AS rolling FROM t WINDOW x AS (PARTITION BY variant ORDER BY step ROWS 19 PRECEDING)")
def trace_rolling20(spark, sf_dir):
    return traces.rolling(event_trace(spark, sf_dir))


@query(f"""WITH {EVENTS}, n AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY variant) // 20) AS n FROM t)
 SELECT a.variant, a.step, round(CAST(sum(b.wall) AS DOUBLE) / count(*), 6) AS rolling FROM n a JOIN n b ON a.variant = b.variant AND b.step BETWEEN a.step - a.n + 1 AND a.step GROUP BY 1, 2""")
def trace_rolling_pct(spark, sf_dir):
    return traces.rolling_share(event_trace(spark, sf_dir))


@query(f"WITH {EVENTS}, {TOTALS} SELECT s.variant, round(b.total_ms / nullif(s.total_ms, 0), 6) AS speedup FROM s, s b WHERE b.variant = '{BASELINE}'")
def trace_speedup(spark, sf_dir):
    return traces.speedups(event_trace(spark, sf_dir), BASELINE)


_NEAREST = "SELECT variant, max(wall_ms) FILTER (i - 1 = least(floor(n * 0.5), n - 1)) AS p50, max(wall_ms) FILTER (i - 1 = least(floor(n * 0.95), n - 1)) AS p95 FROM (SELECT variant, wall_ms, row_number() OVER (PARTITION BY variant ORDER BY wall_ms) AS i, count(*) OVER (PARTITION BY variant) AS n FROM t) GROUP BY variant"


@query(f"WITH {EVENTS}, {TOTALS}, p AS ({_NEAREST}), b AS (SELECT max(total_ms) FILTER (variant = '{BASELINE}') AS base FROM s) SELECT variant, steps, round(total_ms, 6) AS total_ms, round(total_ms / steps, 6) AS mean_ms, p50, p95, round(coalesce(base / nullif(total_ms, 0), 1), 6) AS speedup FROM s JOIN p USING (variant), b")
def trace_summary_percentiles(spark, sf_dir):
    return traces.summary(event_trace(spark, sf_dir), BASELINE)


@query(f"WITH {EVENTS} SELECT variant, round(median(wall_ms), 6) AS median_ms FROM t GROUP BY variant")
def trace_median(spark, sf_dir):
    return traces.medians(event_trace(spark, sf_dir))


_PAIRED = f"{EVENTS}, p AS (SELECT a.step, a.wall_ms AS t_seq, CASE WHEN b.step % 10 = 0 THEN 0.0 ELSE b.wall_ms END AS t_par FROM t a JOIN t b ON a.step = b.step WHERE a.variant = '{BASELINE}' AND b.variant = 'view')"


def _paired(spark, sf_dir) -> DataFrame:
    t = event_trace(spark, sf_dir)
    par = F.when(F.col("step") % 10 == 0, F.lit(0.0)).otherwise(F.col("wall_ms"))
    return t.where(F.col("variant") == BASELINE).select("step", F.col("wall_ms").alias("t_seq")).join(t.where("variant = 'view'").select("step", par.alias("t_par")), "step")


@query(f"WITH {_PAIRED} SELECT step, round(t_seq / nullif(t_par, 0), 6) AS speedup, coalesce(round(t_seq / nullif(t_par, 0), 6), 0) AS speedup0 FROM p")
def trace_step_speedup(spark, sf_dir):
    return traces.step_speedup(_paired(spark, sf_dir))


@query(f"""WITH {W}, {_PAIRED}, e AS (SELECT count(*) AS n, CAST(sum(CAST(t_seq AS DECIMAL(18, 6))) AS DOUBLE) AS a, CAST(sum(CAST(t_par AS DECIMAL(18, 6))) AS DOUBLE) AS b FROM p), u AS (SELECT count(*) AS unique_words, CAST(ceil(count(*) / 256.0) * 256 AS BIGINT) AS threads FROM w)
 SELECT n AS num_merges, unique_words, threads, round(a / 1000, 6) AS total_seq_s, round(b / 1000, 6) AS total_par_s, round(a / b, 6) AS speedup, round(a / b * 100 / CAST(threads AS DOUBLE), 6) AS efficiency_percent, round(n * 1000 / a, 6) AS seq_throughput, round(n * 1000 / b, 6) AS par_throughput FROM e, u""")
def efficiency_report(spark, sf_dir):
    log = _paired(spark, sf_dir).select(F.col("t_seq").alias("t_seq_ms"), F.col("t_par").alias("t_par_ms"))
    return traces.efficiency(log, counts(spark, sf_dir))


_COMPARED = 5
_logs: dict[tuple[str, str], DataFrame] = {}


def engine_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of both training engines, written as CSV and read again; made once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _logs:
        path = _out(spark)
        files.write_csv(engines.compare(kept_counts(spark, sf_dir), _COMPARED), path)
        _logs[key] = files.read_csv(spark, path, engines.LOG)
    return _logs[key]


@query(f"{training_sql(_COMPARED)} SELECT step AS iter, l AS \"left\", r AS \"right\", freq AS pair_count, true AS timed FROM m")
def engine_comparison(spark, sf_dir):
    timed = (F.col("t_seq_ms") > 0) & (F.col("t_par_ms") > 0) & (F.abs(F.col("speedup") * F.col("t_par_ms") - F.col("t_seq_ms")) < 0.01)
    return engine_log(spark, sf_dir).select("iter", "left", "right", "pair_count", timed.alias("timed"))


@query(f"WITH {W} SELECT {_COMPARED} AS num_merges, count(*) AS unique_words, CAST(ceil(count(*) / 256.0) * 256 AS BIGINT) AS threads, true AS consistent FROM w")
def engine_efficiency(spark, sf_dir):
    made = traces.efficiency(engine_log(spark, sf_dir), kept_counts(spark, sf_dir))
    near = lambda a, b: F.abs(a - b) <= 0.01 * F.abs(b) + 1e-5
    consistent = near(F.col("speedup"), F.col("total_seq_s") / F.col("total_par_s")) & near(F.col("efficiency_percent"), F.col("speedup") * 100 / F.col("threads"))
    return made.select(F.col("num_merges").cast("int").alias("num_merges"), "unique_words", "threads", consistent.alias("consistent"))


@query("WITH s AS (SELECT user_id % 4 + 1 AS n, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS total_ms FROM events GROUP BY 1), f AS (SELECT * FROM s ORDER BY n LIMIT 1) SELECT s.n, round(f.total_ms / s.total_ms, 6) AS speedup, CAST(s.n AS DOUBLE) AS ideal, round(CAST(s.n AS DOUBLE) / f.n, 6) AS relative_ideal FROM s, f")
def trace_scaling(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4 + 1).alias("n")).agg(F.sum(F.col("value").cast(traces.WALL)).cast("double").alias("total_ms"))
    return traces.scaling(e)


VARIANTS = ["click", "error", "purchase", "signup", "view"]


@query(f"WITH {EVENTS} SELECT step AS position, " + ", ".join(f"max(wall_ms) FILTER (variant = '{v}') AS {v}" for v in VARIANTS) + " FROM t GROUP BY step")
def trace_position_pivot(spark, sf_dir):
    return traces.by_position(event_trace(spark, sf_dir), VARIANTS)


@query(f"WITH {EVENTS}, n AS (SELECT variant, count(*) AS steps FROM t GROUP BY variant), {TOTALS}, p AS (SELECT s.variant, round(b.total_ms / nullif(s.total_ms, 0), 6) AS speedup FROM s, s b WHERE b.variant = '{BASELINE}'), f AS (SELECT * FROM p WHERE speedup > 1 ORDER BY speedup DESC, variant DESC LIMIT 1) SELECT (SELECT max(steps) FROM n) AS total_merges, (SELECT count(*) FROM n) AS variants, coalesce((SELECT speedup FROM f), 1.0) AS max_speedup, coalesce((SELECT variant FROM f), '-') AS fastest")
def summary_tiles(spark, sf_dir):
    return traces.tiles(event_trace(spark, sf_dir), BASELINE)


@query(f"WITH {EVENTS} SELECT variant, step, wall_ms FROM t WHERE step % 100 = 0 OR step <= 20")
def progress_rows(spark, sf_dir):
    return traces.progress(event_trace(spark, sf_dir), 100, 20).select("variant", "step", "wall_ms")


@query(f"WITH {EVENTS} SELECT variant, step, wall_ms FROM t WHERE variant <> 'view' UNION ALL SELECT 'view', step, wall_ms * 2 FROM t WHERE variant = 'view'")
def trace_replace_variant(spark, sf_dir):
    t = event_trace(spark, sf_dir).select("variant", "step", "wall_ms")
    return traces.replace_variants(t, t.where("variant = 'view'").withColumn("wall_ms", F.col("wall_ms") * 2))


@query(f"WITH {EVENTS} SELECT variant, step, wall_ms, CAST(NULL AS BIGINT) AS freq FROM t WHERE variant = 'click' UNION ALL SELECT variant, step, wall_ms, event_id FROM t WHERE variant = 'view'")
def trace_union(spark, sf_dir):
    t = event_trace(spark, sf_dir)
    return traces.union([t.where("variant = 'click'").select("variant", "step", "wall_ms"), t.where("variant = 'view'").select("variant", "step", "wall_ms", F.col("event_id").alias("freq"))])


# words stand in for merges: step by frequency, the pair is the first character and the rest
_MERGES = f"{W}, m AS (SELECT row_number() OVER (ORDER BY freq DESC, word) AS step, substr(word, 1, 1) AS pair_a, substr(word, 2) AS pair_b, freq FROM w)"


def word_merges(spark, sf_dir) -> DataFrame:
    w = traces.numbered(counts(spark, sf_dir), F.desc("freq"), F.asc("word"))
    return w.select("step", F.substring("word", 1, 1).alias("pair_a"), F.expr("substring(word, 2)").alias("pair_b"), "freq")


@query(f"WITH {_MERGES} SELECT step, pair_a, pair_b, freq, pair_a || pair_b AS merged, length(pair_a) + length(pair_b) AS merged_len, round(freq * 100.0::DOUBLE / (SELECT max(freq) FROM m), 6) AS percent FROM m ORDER BY freq DESC, step LIMIT 30")
def merge_top30(spark, sf_dir):
    return traces.top_merges(word_merges(spark, sf_dir))


@query(f"WITH {_MERGES} SELECT step, pair_a, pair_b, freq FROM m ORDER BY freq, step LIMIT 10")
def merge_bottom10(spark, sf_dir):
    return traces.bottom_merges(word_merges(spark, sf_dir))


@query(f"WITH {_MERGES} SELECT step, pair_a, pair_b, freq FROM m WHERE contains(lower(pair_a || pair_b), 'th') ORDER BY step LIMIT 100")
def merge_search(spark, sf_dir):
    return traces.search(word_merges(spark, sf_dir), "Th")


@query(f"WITH {_MERGES}, x AS (SELECT *, min(step) OVER () AS lo, max(step) OVER () AS hi FROM m) SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE greatest(ceil((step - lo) * 10.0::DOUBLE / (hi - lo)) - 1, 0) END AS INT) AS bin, length(pair_a) + length(pair_b) AS merged_len, round(avg(freq), 6) AS mean_freq FROM x GROUP BY 1, 2")
def heatmap_cut(spark, sf_dir):
    return traces.heatmap_cut(word_merges(spark, sf_dir))


@query(f"WITH {_MERGES}, x AS (SELECT *, max(step) OVER () AS hi FROM m WHERE true) SELECT CAST(least(floor((step - 1) * 10.0::DOUBLE / hi), 9) AS INT) AS bin, length(pair_a) + length(pair_b) AS merged_len, round(avg(freq), 6) AS mean_freq FROM x WHERE length(pair_a) + length(pair_b) <= 12 GROUP BY 1, 2")
def heatmap_floor(spark, sf_dir):
    return traces.heatmap_floor(word_merges(spark, sf_dir))


# file names made of events: every kind of name, a folder before it or not, in either case
_MADE = """CASE event_id % 9 WHEN 0 THEN 'seq_' || user_id WHEN 1 THEN 'omp_' || user_id || 't' WHEN 2 THEN 'mpi_run' || user_id || 'p_' || event_type
 WHEN 3 THEN 'cuda_' || event_type WHEN 4 THEN 'hybrid_' || user_id || 'p' WHEN 5 THEN 'hybrid_' || event_type WHEN 6 THEN event_type || user_id
 WHEN 7 THEN 'OMP-' || event_type || user_id || 'T' ELSE 'x.csv' || user_id END"""
_NAMED = f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'out/' || event_type || '/' ELSE '' END || {_MADE} || CASE WHEN event_id % 5 = 0 THEN '.txt' WHEN event_id % 7 = 0 THEN '.CSV' ELSE '.csv' END AS file FROM events"""
_FILES = f"x AS (SELECT event_id, file, regexp_extract(file, '[^/]*$') AS name, lower(regexp_extract(file, '[^/]*$')) AS low FROM ({_NAMED}))"
_LABELS = """l AS (SELECT event_id, file, CASE WHEN contains(low, 'seq') THEN 'Sequential'
 WHEN contains(low, 'hybrid') THEN CASE WHEN regexp_matches(low, '[0-9]+p') THEN 'Hybrid-' || regexp_extract(low, '([0-9]+)p', 1) || 'p' ELSE 'Hybrid' END
 WHEN contains(low, 'cuda') THEN 'CUDA' WHEN regexp_matches(low, 'omp.*?[0-9]+t') THEN 'OMP-' || regexp_extract(low, 'omp.*?([0-9]+)t', 1) || 't'
 WHEN regexp_matches(low, 'mpi.*?[0-9]+p') THEN 'MPI-' || regexp_extract(low, 'mpi.*?([0-9]+)p', 1) || 'p' ELSE replace(name, '.csv', '') END AS label FROM x)"""


def _files(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("lexigrain_events")
    return spark.sql(_NAMED.replace("FROM events", "FROM lexigrain_events"))


@query(f"WITH {_FILES}, {_LABELS} SELECT event_id, file, label, CASE WHEN lower(label) LIKE '%seq%' THEN 'seq' WHEN lower(label) LIKE '%omp%' THEN 'omp' WHEN lower(label) LIKE '%hybrid%' THEN 'hybrid' WHEN lower(label) LIKE '%cuda%' THEN 'cuda' WHEN lower(label) LIKE '%mpi%' THEN 'mpi' ELSE 'seq' END AS class FROM l")
def label_inference(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("label", T.variant_label(F.col("file")))
    return f.withColumn("class", T.variant_class(F.col("label")))


@query(f"WITH {_FILES} SELECT event_id, file FROM x WHERE lower(file) LIKE '%.csv'")
def csv_file_names(spark, sf_dir):
    return files.only_csv(_files(spark, sf_dir), "file")


@query("SELECT part.p_partkey AS k, CASE WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.1fk', v / 1e3) WHEN v >= 100 THEN printf('%.0f', v) ELSE printf('%.2f', v) END AS shown FROM (SELECT p_partkey, CAST(p_partkey * p_partkey AS DOUBLE) + 0.3 AS v FROM part) part")
def number_format(spark, sf_dir):
    v = F.col("p_partkey").cast("bigint") * F.col("p_partkey").cast("bigint")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.short_number(v.cast("double") + 0.3).alias("shown"))


# --- first rows, grids, families
@query(f"WITH {_MERGES} SELECT step, pair_a, pair_b, freq FROM m WHERE step <= 50")
def merge_first_steps(spark, sf_dir):
    return traces.first_steps(word_merges(spark, sf_dir), 50)


@query(f"WITH {EVENTS} SELECT variant, step, wall_ms FROM t ORDER BY step, variant LIMIT 10")
def trace_head(spark, sf_dir):
    return traces.head(event_trace(spark, sf_dir), 10).select("variant", "step", "wall_ms")


@query(f"SELECT doc_id, array_to_string(list_slice({TOK.format('text')}, 1, 3), ' ') AS words FROM documents")
def first_three_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(T.whitespace_tokens(F.col("text")), 1, 3), " ").alias("words"))


@query(f"WITH {_MERGES}, x AS (SELECT *, length(pair_a) + length(pair_b) AS n, min(step) OVER () AS lo, max(step) OVER () AS hi FROM m), y AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE greatest(ceil((step - lo) * 10.0::DOUBLE / (hi - lo)) - 1, 0) END AS INT) AS bin, n, freq FROM x) SELECT bin, " + ", ".join(f'coalesce(round(avg(freq) FILTER (n = {k}), 6), 0.0) AS "{k}"' for k in range(1, 13)) + " FROM y GROUP BY bin")
def heatmap_cut_grid(spark, sf_dir):
    return traces.heatmap_grid(traces.heatmap_cut(word_merges(spark, sf_dir)), list(range(1, 13)))


_FAMILY = "SELECT CASE WHEN user_id % 5 < 3 THEN 'OMP-' || (2 ** (user_id % 5))::INT || 't' ELSE 'MPI-' || (user_id % 5) || 'p' END AS variant, value FROM events"


def _family(spark, sf_dir) -> DataFrame:
    k = F.col("user_id") % 5
    name = F.when(k < 3, F.concat(F.lit("OMP-"), F.pow(F.lit(2), k).cast("int").cast("string"), F.lit("t"))).otherwise(F.concat(F.lit("MPI-"), k.cast("string"), F.lit("p")))
    return table(spark, sf_dir, "events").select(name.alias("variant"), F.col("value").alias("wall_ms"))


@query(f"WITH e AS ({_FAMILY}), s AS (SELECT CAST(regexp_extract(variant, '[0-9]+') AS INT) AS n, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) AS total_ms FROM e WHERE variant LIKE 'OMP%' GROUP BY 1), f AS (SELECT * FROM s ORDER BY n LIMIT 1) SELECT s.n, round(f.total_ms / s.total_ms, 6) AS speedup, CAST(s.n AS DOUBLE) AS ideal, round(CAST(s.n AS DOUBLE) / f.n, 6) AS relative_ideal FROM s, f")
def family_scaling(spark, sf_dir):
    return traces.scaling(traces.family(_family(spark, sf_dir), "OMP"))


# --- hashes and cells
_BYTES = "[CAST(('0x' || b) AS HUGEINT) FOR b IN regexp_extract_all(hex(encode({0})), '..')]"
_H31 = "list_reduce(list_prepend(CAST(5381 AS HUGEINT), {0}), lambda h, b: (h * 31 + b) % 18446744073709551616) % 4096"


@query(f"WITH {W} SELECT word, CAST({_H31.format(_BYTES.format('word'))} AS BIGINT) AS h31, CAST({_H31.format(_BYTES.format(chr(34) + 'p' + chr(34)))} AS BIGINT) AS pair31, CAST(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), {_BYTES.format('word')}), lambda h, b: (CAST(xor(CAST(h AS BIGINT), CAST(b AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296) AS BIGINT) AS fnv FROM (SELECT word, substr(word, 1, 1) || '#' || substr(word, 2) AS p FROM w)")
def word_hashes(spark, sf_dir):
    w = F.col("word")
    pair = T.pair_times31(F.substring(w, 1, 1), F.expr("substring(word, 2)"), 4096)
    return counts(spark, sf_dir).select("word", T.times31(w, 4096).alias("h31"), pair.alias("pair31"), T.fnv1a(w).alias("fnv"))


_NUMBER = r"regexp_full_match(word, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"


@query(f"WITH {W} SELECT word AS cell, CASE WHEN {_NUMBER} THEN try_cast(word AS DOUBLE) END AS number, CASE WHEN NOT {_NUMBER} THEN word END AS text FROM w")
def number_or_text_cells(spark, sf_dir):
    number, text = T.number_or_text(F.col("word"))
    return counts(spark, sf_dir).select(F.col("word").alias("cell"), number.alias("number"), text.alias("text"))


# --- files: written and read again
def _out(spark) -> str:
    """A new path in a shared folder that goes when the session ends."""
    return f"{Folder(spark).path}/files"


@query("SELECT x AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark) GROUP BY x")
def corpus_write_read(spark, sf_dir):
    path = _out(spark)
    files.write_corpus(table(spark, sf_dir, "benchmark"), path)
    whole = files.read_corpus(spark, f"{path}/none", path)  # the first that is there
    body = F.regexp_replace("text", "\n$", "")
    return whole.where("text <> ''").select(F.explode(F.split(body, "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


def mixed_sql(x: str, seed: int) -> str:
    out = f"(({x}) % 2147483647)"
    for _ in range(3):
        out = f"(({out} * 48271 + {seed * 40692 + 11}) % 2147483647)"
    return f"({out} % 1000000)"


# the generators' fixed values, written out for the SQL by itself
_DEMO_TEXT = "the cat sat on mat a big small dog ran fast slow jumped over fence house mouse cheese ate drank water milk car truck bus plane train boat ship air"
_DEMO_VARIANTS = "(VALUES (0, 'Sequential', 45, 1.00), (1, 'OMP-2t', 25, 0.95), (2, 'OMP-4t', 14, 0.90), (3, 'MPI-2p', 22, 0.92), (4, 'MPI-4p', 12, 0.85), (5, 'CUDA', 8, 0.98)) c(k, variant, base, scale)"
_DEMO_PAIRS = "t h,h e,in g,e r,a n,o n,e d,th e,i n,re s,s t,a t,l e,i t,o f,e n,a r,o r,n d,c e,i s,t er,a l,i c,r e,d e,s e,he r,c o,m e"


@query(f"""SELECT word, count(*) AS freq, count(DISTINCT doc_id) AS lines FROM (SELECT doc_id, string_split('{_DEMO_TEXT}', ' ')[CAST({mixed_sql('doc_id * 20 + i', 42)} % 30 AS INT) + 1] AS word
 FROM documents, range(20) p(i)) GROUP BY word""")
def demo_corpus_counts(spark, sf_dir):
    """A generated line for each document."""
    w = files.demo_lines(table(spark, sf_dir, "documents"), "doc_id").select("line", F.explode(F.split("text", " ")).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("freq"), F.count_distinct("line").alias("lines"))


@query(f"""WITH s AS (SELECT CAST(event_id + 1 AS INT) AS step FROM events), t AS (SELECT *, string_split(string_split('{_DEMO_PAIRS}', ',')[step % 30 + 1], ' ') AS p FROM s, {_DEMO_VARIANTS})
 SELECT variant, step, p[1] AS pair_a, p[2] AS pair_b, CAST(round(2000 / ln(step + 2.0::DOUBLE) + {mixed_sql('step::BIGINT * 6 + k', 43)} / 5000.0::DOUBLE) AS BIGINT) AS freq,
 ((greatest(10000000, base * CAST(scale * 100 AS BIGINT) * 100000 + {mixed_sql('step::BIGINT * 6 + k', 42)} * base * 3 - base * 1500000 + step::BIGINT * 200000) + 5000) // 10000) / 1000.0::DOUBLE AS wall_ms,
 CASE WHEN k = 0 THEN CAST(floor(250.5 + CASE WHEN step < 50 THEN 2.0 * step WHEN step < 150 THEN 98 + (step - 49) ELSE 198 + 0.5 * (step - 149) END) AS BIGINT) END AS vocab_size,
 CASE WHEN k = 0 THEN round(1 + step * 0.008::DOUBLE, 4) END AS avg_tok_len FROM t""")
def demo_trace_columns(spark, sf_dir):
    """Generated traces of as many steps as there are events."""
    return files.demo_steps(table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("step")))


@query(f"WITH {_MERGES} SELECT CAST(step AS INT) AS step, pair_a, pair_b, freq FROM m")
def trace_csv_round_trip(spark, sf_dir):
    path = _out(spark)
    files.write_csv(word_merges(spark, sf_dir).select("step", "pair_a", "pair_b", "freq"), path)
    return files.read_csv(spark, path, "step int, pair_a string, pair_b string, freq bigint")


_NAMES = {"click": "seq_results", "error": "omp_2t", "purchase": "mpi_4p", "signup": "cuda_results", "view": "hybrid_2p"}
_BECOME = {"click": "Sequential", "error": "OMP-2t", "purchase": "MPI-4p", "signup": "CUDA", "view": "Hybrid-2p"}


@query(f"WITH {EVENTS} SELECT CASE variant " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _BECOME.items()) + " END AS variant, count(*) AS steps, CAST(sum(wall) AS DOUBLE) AS total_ms FROM t GROUP BY 1")
def trace_folder_read(spark, sf_dir):
    path, t = _out(spark), event_trace(spark, sf_dir)
    for old in ("a_old", "b_new"):  # of one label the last by name counts
        for variant, name in _NAMES.items():
            files.write_csv(t.where(F.col("variant") == variant).select("step", F.col("wall_ms") if old == "b_new" else F.lit(0.0).alias("wall_ms")), f"{path}/{old}/{name}.csv")
    return traces.variant_totals(files.read_traces(spark, path, "step int, wall_ms double")).select("variant", "steps", "total_ms")


@query(ORACLES["efficiency_report"])
def report_json_round_trip(spark, sf_dir):
    path, report = _out(spark), efficiency_report(spark, sf_dir)
    files.write_json(report, path)
    return files.read_json(spark, path, report.schema)


@query(ORACLES["trace_summary_percentiles"])
def summary_csv_round_trip(spark, sf_dir):
    path, made = _out(spark), trace_summary_percentiles(spark, sf_dir)
    files.write_csv(made, path)
    return files.read_csv(spark, path, made.schema)
