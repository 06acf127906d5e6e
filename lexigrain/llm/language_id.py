"""Language identification by Bayesian fusion of four kinds of evidence.

- Text: naive Bayes over words and character trigrams, fitted on about
  ``train_rows`` labelled documents, drawn by hash from each language in one scan, copies of a text once; the log
  likelihood is divided by a length factor, as neighbouring features are not independent.
- Declared language of the markup (`<html lang=...>`), trusted to DECLARED.
- Address suffix: a country suffix of one of the languages, trusted to SUFFIX.
- Host prior: text posteriors of all other pages, added up by host, by registered
  domain and over all pages (grouped aggregation), the page's own taken off at each
  level; each level is smoothed with the one above, with STRENGTH pages' worth of weight.

The posterior is the normalised product.  Hosts are never gathered: sums are
partially aggregated, and joined back by host.

Defined results: a null or empty page has no text evidence; no declaration,
suffix or host leaves that evidence out (a null address has the prior of all pages);
ties go to the first language by name; every input row gives a row, repeated rows
count; without labelled rows there is no language: lang is null; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .warc import declared_language, plain_text

TRAIN_ROWS = 4000
DECLARED, SUFFIX, STRENGTH = 0.8, 0.6, 20.0
#: Country suffixes and their main language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}
#: Labels below which countries give names.
SECOND_LEVEL = {"ac", "co", "com", "edu", "gob", "gov", "net", "org"}
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        out[w] += n
        padded = f" {w} "
        for i in range(len(padded) - 2):
            out[padded[i : i + 3]] += n
    return out


def registered_domain(host: str) -> str:
    """The last two labels, or three where the last but one is an administrative one below a country (`co.uk`)."""
    labels = host.split(".")
    below = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL
    return ".".join(labels[-3 if below else -2 :])


class TextModel:
    """Log likelihoods of all features of the labelled rows by language."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({lang for _, lang in rows})
        counts = {lang: Counter() for lang in self.languages}
        for text, lang in rows:
            counts[lang].update(features(text))
        total = Counter()
        for c in counts.values():
            total.update(c)
        known = sorted(total, key=lambda f: (-total[f], f))
        table = np.array([[counts[lang][f] for lang in self.languages] for f in known], dtype=np.float64).reshape(len(known), len(self.languages)) + 0.5
        self.weights = dict(zip(known, np.log(table / table.sum(axis=0, keepdims=True)), strict=True))

    def log_likelihood(self, text: str) -> np.ndarray:
        out, n = np.zeros(len(self.languages)), 0
        for f, k in features(text).items():
            if (w := self.weights.get(f)) is not None:
                out += k * w
                n += k
        return out / (1 + n / 40)


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> TextModel:
    """A model of about train_rows whole texts: of each language an equal share, those of the smallest hash."""
    source = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = sorted((r["count"], r["lang"]) for r in source.groupBy("lang").count().collect())
    if not sizes:
        return TextModel([])
    shares, limits, left = [], [], train_rows
    for k, (size, lang) in enumerate(sizes):
        share = max(1, left // (len(sizes) - k))
        left -= min(size, share)
        shares += [F.lit(lang), F.lit(share)]
        limits += [F.lit(lang), F.lit(int(min(1.0, (2 * share + 10) / size) * (1 << 53)))]  # of 53 bits; some more than needed
    drawn = source.withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 11))
    drawn = drawn.where(F.col("hash") < F.create_map(*limits)[F.col("lang")]).dropDuplicates(["lang", "text"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "text"))
    rows = drawn.withColumn("place", place).where(F.col("place") <= F.create_map(*shares)[F.col("lang")]).select("text", "lang").collect()
    return TextModel([tuple(r) for r in rows])


def identify(pages: DataFrame, model: TextModel, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, declared, suffix, text_lang, lang, posterior for every page."""
    spark, languages = pages.sparkSession, model.languages
    scratch, shared = Scratch(spark), spark.sparkContext.broadcast(model)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list[tuple] = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                m, lang = _HOST.match(url or ""), declared_language(page or "")
                host = m[1].lower() if m else None
                declared = lang.split("-")[0] if lang else None
                suffix = SUFFIXES.get(host.rpartition(".")[2]) if host else None
                domain = registered_domain(host) if host else None
                out.append((host, domain, declared, suffix, model.log_likelihood(plain_text(page)).tolist() if page else [0.0] * len(model.languages)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = [pa.string()] * 4 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["page_id", "host", "domain", "declared", "suffix", "text"])

    found = scratch.save(source.mapInArrow(evidence, f"page_id {kind}, host string, domain string, declared string, suffix string, text array<double>"), "evidence")
    if not languages:
        nothing = F.lit(None).cast("string")
        return found.select("page_id", "host", "declared", "suffix", nothing.alias("text_lang"), nothing.alias("lang"), F.lit(None).cast("double").alias("posterior"))
    k = range(len(languages))

    def normal(logs: list) -> list:
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        whole = sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top))
        return [F.exp(x - top) / whole for x in logs]

    alone = normal([F.get("text", F.lit(i)) for i in k])
    soft = found.select("host", "domain", *[p.alias(f"p{i}") for i, p in zip(k, alone, strict=True)])
    hosts = soft.groupBy("host", "domain").agg(F.count("*").alias("n"), *[F.sum(f"p{i}").alias(f"s{i}") for i in k])
    hosts = scratch.save(hosts, "hosts")
    domains = hosts.where("domain is not null").groupBy("domain").agg(F.sum("n").alias("dn"), *[F.sum(f"s{i}").alias(f"d{i}") for i in k])
    world = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), *[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in k]).first()
    priors = hosts.where("host is not null").join(domains, "domain").drop("domain")
    joined = found.join(priors, "host", "left")
    # what the page itself has added is taken off at each level, so that its text counts once
    own = lambda i: alone[i]
    every = [(F.lit(world[i + 1]) - own(i) + 1.0) / F.lit(float(world[0] - 1 + len(languages))) for i in k]
    up = [F.when(F.col("dn").isNull(), e).otherwise((F.col(f"d{i}") - own(i) + STRENGTH * e) / (F.col("dn") - 1 + STRENGTH)) for i, e in zip(k, every, strict=True)]
    prior = [F.when(F.col("n").isNull(), e).otherwise((F.col(f"s{i}") - own(i) + STRENGTH * u) / (F.col("n") - 1 + STRENGTH)) for i, e, u in zip(k, every, up, strict=True)]
    joined = joined.withColumns({f"q{i}": F.greatest(p, F.lit(1e-12)) for i, p in zip(k, prior, strict=True)})

    def trust(column: str, share: float, lang: str):
        known = F.col(column).isin(languages)
        return F.when(known, F.log(F.when(F.col(column) == lang, F.lit(share)).otherwise(F.lit((1 - share) / max(1, len(languages) - 1))))).otherwise(F.lit(0.0))

    logs = [F.get("text", F.lit(i)) + F.log(f"q{i}") + trust("declared", DECLARED, lang) + trust("suffix", SUFFIX, lang) for i, lang in zip(k, languages, strict=True)]
    best = lambda values: F.array_max(F.array(*[F.struct(v.alias("p"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, v, lang in zip(k, values, languages, strict=True)]))
    made = joined.select("page_id", "host", "declared", "suffix", best([F.get("text", F.lit(i)) for i in k]).alias("t"), best(normal(logs)).alias("b"), F.exists("text", lambda x: x != 0).alias("has"))
    return made.select("page_id", "host", "declared", "suffix", F.when(F.col("has"), F.col("t.lang")).alias("text_lang"), F.col("b.lang").alias("lang"), F.col("b.p").alias("posterior"))
