"""The opN_ queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, jaccard, language_id, line_dedup, packing, periodic_runs, ppm, quality, token_counts, token_files, warc
from .common import Scratch, let, sql_words

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, end_mark = token_counts.vocabulary(tokenizer_path())
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces, end_mark=end_mark, byte_level=True)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(table(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), language_id.fit(table(spark, sf_dir, "documents")))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m.start.cast("string"), m.end.cast("string")))
    return made.withColumn("mask", F.array_join(spans, ","))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs whose text, for a tenth of the ids by crc32, repeats a part of itself up to the end, as the contract says."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    text = F.when((h % 10 == 0) & F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"), let(sql_words(F.col("text")), planted)).otherwise(F.col("text"))
    return docs.withColumn("text", text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    made = made.withColumn("best", best)
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).dir}/tokens"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_packing, op3_quality_rules, op4_line_dedup, op5_token_counts, op6_warc, op7_lm_scoring, op8_language_id, op9_chat_formatting, op10_ngram_jaccard, op11_source_divergence, op12_periodic_runs, op13_token_files)
}

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, spot.n, i, item_id FROM spot JOIN win ON spot.g = win.g AND spot.n = win.n),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {_WORDS.format("t")} AS ws FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM tri) WHERE k > 1) GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             len(string_split(t, chr(10))) AS lines, length(t) - length(replace(t, '!', '')) AS bangs,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS lettered,
             length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS capitals,
             len(regexp_extract_all(t, '(?m)(?:\.\.\.|…)[ \t]*$')) AS ellipses
      FROM w LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_dup_lines > 4 AND 2 * n_dup_lines > lines)
            OR 10 * lettered < 7 * n_words OR 10 * bangs > 3 * n_words OR 2 * capitals > letters OR 10 * ellipses > 3 * lines) AS kept
FROM b
"""

OP9_SQL = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS place FROM c),
t AS (SELECT conv_id, place // 1024 AS block, place, role, text, true AS own FROM n),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM c WHERE role IS NOT NULL AND role <> 'system'),
y AS (SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, text) AS k FROM c WHERE role = 'system') WHERE k = 1),
u AS (SELECT * FROM t UNION ALL SELECT b.conv_id, b.block, -1, 'system', y.text, false FROM (SELECT DISTINCT conv_id, block FROM t WHERE block > 0) b JOIN y ON b.conv_id IS NOT DISTINCT FROM y.conv_id),
r AS (SELECT u.conv_id, block, speaker, place, own, coalesce(role = speaker, false) AS mine,
             CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
                  ELSE '<|user name=' || coalesce(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), 'unknown') || '|>' || chr(10) END AS head,
             replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') || '<|end|>' AS body
      FROM u JOIN p ON u.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, row_number() OVER w AS k, sum(length(head) + length(body) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS until
      FROM r WINDOW w AS (PARTITION BY conv_id, block, speaker ORDER BY place))
SELECT conv_id, CAST(block AS BIGINT) AS block, speaker, count(*) FILTER (own) AS n_turns, CAST(count(*) FILTER (mine) AS BIGINT) AS n_targets,
       string_agg(head || body || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(until - 1 - length(body) AS BIGINT)::VARCHAR || '-' || CAST(until - 1 AS BIGINT)::VARCHAR, ',' ORDER BY k) FILTER (mine), '') AS mask
FROM o GROUP BY conv_id, block, speaker
"""

OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_AZ.format("coalesce(text, '')"))} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
       SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
       UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT x AS a, y AS b FROM (SELECT p.doc_id AS x, q.doc_id AS y, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2)
       JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 75 * (u.n + v.n - c)),
walk AS (SELECT a AS x, a AS y FROM (SELECT DISTINCT a FROM link) UNION SELECT walk.x, link.b FROM walk JOIN link ON walk.y = link.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM walk GROUP BY x) c ON c.x = d.doc_id
"""

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS MATERIALIZED (SELECT lang, source, t, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS t FROM d) GROUP BY 1, 2, 3),
k AS MATERIALIZED (SELECT lang, t, sum(n) AS n FROM o GROUP BY 1, 2 HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT g.lang, g.source, k.t, coalesce(o.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.t = k.t),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS MATERIALIZED (SELECT c.lang, c.source, c.t, c.n, 1 + CAST(1000000000 AS HUGEINT) * (c.n + 1) // (s.total + v.v) AS p FROM c JOIN s USING (lang, source) JOIN v USING (lang)),
q AS (SELECT k.lang, k.t, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (v.total + v.v) AS q FROM k JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
term AS (SELECT lang, source, t AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
x AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= 200
"""

_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(('0x' || b) AS BIGINT) FOR b IN regexp_extract_all(hex(encode({0})), '..')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w, {_CRC.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
t AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END FOR i IN range(n)] END AS w FROM a),
u AS MATERIALIZED (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM t),
z AS (SELECT b.r, b.i, c.i - b.i AS q FROM u b JOIN u c ON b.r = c.r AND b.x = c.x AND c.i > b.i AND (c.i - b.i) * 4 <= b.n),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM z) GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
m AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM s GROUP BY 1, 2, 3),
one AS (SELECT r, count(*) AS n_runs, max(row(length, -start, -period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM m GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM m),
kept AS (SELECT u.r, string_agg(x, ' ' ORDER BY u.i) AS words FROM u LEFT JOIN gone ON gone.r = u.r AND gone.i = u.i WHERE gone.i IS NULL GROUP BY u.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-b[2] AS BIGINT) AS start, CAST(b[1] AS BIGINT) AS length, CAST(-b[3] AS BIGINT) AS period,
       CAST(b[1] * 1000 // -b[3] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM t LEFT JOIN one USING (r) LEFT JOIN kept USING (r)
"""

ORACLES: dict[str, str] = {"op11_source_divergence": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op1_decontamination": OP1_SQL, "op3_quality_rules": OP3_SQL, "op9_chat_formatting": OP9_SQL, "op10_ngram_jaccard": OP10_SQL}
