"""Language identification by Bayesian evidence fusion.

Evidence on a page: its text, the language its markup declares, the suffix of its address, its host.

* Text: a naive Bayes model over hashed byte trigrams of lower-cased words, trained here on labelled documents. It
  may use a bounded sample (about ``train_docs`` in equal parts by language, by a hash of the id; a language with fewer
  gives all it has), and each language is mixed with the distribution over all; the page's mean log likelihood per trigram is
  scaled by at most ``most_evidence`` trigrams, as neighbours are not independent.
* Markup and suffix: P(declared | language), P(suffix | language), from grouped counts over all pages by their
  language by text alone, with additive smoothing.
* Host: prior counts by grouped aggregation, smoothed down a hierarchy: everything, the host's parent domain
  (last two labels), the host. Each level counts as its own pages plus ``strength`` times the level above.

The page's own vote is taken out of all its counts. Null html or urls are empty evidence: without text, or with text
that does not tell languages apart, markup, suffix and host decide. A page without any evidence gets the commonest
language. Ties go to the first language by name. Rows that repeat a page are judged each and vote each; no documents
give the single language "und", no pages no rows. Very long pages count whole. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, durable, summed, texts_of
from tidemark.llm.url_filters import host_and_path

BINS = 1 << 15
#: Languages whose tables travel together: 8 MB.
BLOCK = 64
#: Weight of the distribution over all languages in that of each.
POOLED = 0.3


def trigrams(text: bytes) -> np.ndarray:
    """The hashed byte trigrams of the text, A-Z as a-z, other than those of ASCII non-letters alone."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    letter = (b >= 128) | ((b >= 97) & (b <= 122))
    b = np.where(letter, b, 32)
    some = letter[:-2] | letter[1:-1] | letter[2:]
    h = (b[:-2] * np.uint32(2654435761) ^ b[1:-1] * np.uint32(40503) << np.uint32(7) ^ b[2:] * np.uint32(2246822519)) >> np.uint32(9)
    return (h[some] % BINS).astype(np.int64)


def trained(documents: DataFrame, train_docs: int) -> tuple[list[str], list[np.ndarray]]:
    """(languages, log P(trigram | language) in blocks of BLOCK languages, BINS numbers each); every label is a language."""
    rows = documents.where("lang is not null and text is not null and doc_id is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    languages = sorted(found)
    if not languages:
        return ["und"], [np.zeros((1, BINS), np.float32)]
    quota = max(1, train_docs // len(languages))
    counts = []
    for first in range(0, len(languages), BLOCK):
        block = languages[first : first + BLOCK]
        place = (F.array_position(F.array(*map(F.lit, block)), F.col("lang")) - 1).cast("int")
        steps = F.array(*[F.lit(max(1, -(-found[name] // quota))) for name in block])
        sample = rows.where(F.col("lang").isin(block)).select("doc_id", place.alias("place"), "text").where(F.pmod(F.xxhash64("doc_id"), F.get(steps, F.col("place"))) == 0)
        counts.append(counted(sample.select("place", "text"), len(block)))
    pooled = np.sum([c.sum(axis=0) for c in counts], axis=0) + 0.5
    return languages, [smoothed(c, pooled / pooled.sum()) for c in counts]


def smoothed(counts: np.ndarray, pooled: np.ndarray) -> np.ndarray:
    """log P(trigram | language): own shares and the pooled ones, with the same weight for each language, so a trigram that
    a language has never had is as unlikely in a small one as in a large one. A language without trigrams is the pool."""
    total = counts.sum(axis=1, keepdims=True)
    own = np.where(total > 0, counts / np.maximum(total, 1), pooled)
    return np.log((1 - POOLED) * own + POOLED * pooled).astype(np.float32)


def counted(rows: DataFrame, n: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n, BINS), np.int64)
        for batch in batches:
            for place, text in zip(batch.column("place").to_pylist(), texts_of(batch), strict=True):
                counts[place] += np.bincount(trigrams(text), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], ["task", "block", "counts"])

    parts = durable(rows.mapInArrow(run, "task int, block int, counts binary"), "lang-counts")
    tasks = parts.agg(F.coalesce(F.max("task"), F.lit(0)) + 1).first()[0]
    counts = np.zeros((n, BINS), np.int64)
    for row in summed(parts, tasks).toLocalIterator():
        counts[row.block] = np.frombuffer(row.counts, np.int64)
    return counts


def visible(html: Column) -> Column:
    """What a reader sees of the markup, roughly: no scripts, styles, comments or tags."""
    gone = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(gone, r"<[^>]*+>", " "), r"&[#A-Za-z0-9]{1,10};", " ")


def scored(pages: DataFrame, models: list) -> DataFrame:
    """pages with scores (mean log likelihood a language) and n (trigrams); pages has no text left.

    A pass for each block of languages, so a task holds one block's table at a time.
    """
    held = pages.columns
    for k, model in enumerate(models):
        pages = pages.mapInArrow(one_pass(model, k, len(models), pages.columns), scored_schema(pages, k, len(models)))
    return pages.select(*[c for c in held if c != "text"], F.concat(*[f"scores{k}" for k in range(len(models))]).alias("scores"), "n")


def scored_schema(pages: DataFrame, k: int, passes: int) -> str:
    kept = [f"{c} {t}" for c, t in pages.dtypes if c != "n" and not (c == "text" and k == passes - 1)]
    return ", ".join([*kept, f"scores{k} array<double>", "n bigint"])


def one_pass(model, k: int, passes: int, columns: list[str]):
    kept = [c for c in columns if c != "n" and not (c == "text" and k == passes - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            scores, many = [], []
            for text in texts_of(batch):
                t = trigrams(text or b"")
                many.append(len(t))
                scores.append(table[:, t].mean(axis=1).tolist() if len(t) else [0.0] * len(table))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.list_(pa.float64())), pa.array(many, pa.int64())], [*kept, f"scores{k}", "n"])

    return run


def votes(rows: DataFrame, field: str, n: int) -> DataFrame:
    """field, array of its pages by their language by text: one grouped aggregation, a row a value."""
    sums = [F.count_if((F.col("by_text") == i) & (F.col("n") > 0)).cast("double") for i in range(n)]
    return rows.where(F.col(field) != "").groupBy(field).agg(F.array(*sums).alias(f"v_{field}"))


def identified(pages: DataFrame, documents: DataFrame, train_docs: int = 20_000, most_evidence: float = 40.0, smooth: float = 1.0, strength: float = 5.0) -> DataFrame:
    """page_id, lang, confidence, by_text (language by text alone), declared, suffix, host for each page."""
    spark = pages.sparkSession
    bounded_batches(pages)
    languages, tables = trained(documents, train_docs)
    n = len(languages)
    host, _ = host_and_path(F.col("url").cast("string"))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"),
        F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,8})""", 1)).alias("declared"),
        visible(html).alias("text"))
    rows = rows.withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)\z", 1)).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)\z", 1))
    best = F.array_position(F.col("scores"), F.array_max("scores")) - 1
    models = [spark.sparkContext.broadcast(t) for t in tables]
    scan = durable(scored(rows, models).withColumn("by_text", best.cast("int")), "lang-scored")
    for model in models:
        model.destroy()
    # all evidence is counted on the scored rows: two numbers a language and two more for the driver, a row a value for the joins
    whole = scan.agg(*[F.count_if((F.col("by_text") == i) & (F.col("n") > 0)).alias(f"w{i}") for i in range(n)], *[F.count_distinct(F.when(F.col(f) != "", F.col(f))).alias(f) for f in ("declared", "suffix")]).first()
    shown = {}
    for field in ("declared", "suffix"):
        told = scan.where((F.col(field) != "") & (F.col("n") > 0)).agg(*[F.count_if(F.col("by_text") == i).alias(f"t{i}") for i in range(n)]).first()
        shown[field] = F.array(*[F.lit(float(told[f"t{i}"] + smooth * (whole[field] + 1))) for i in range(n)])
    base = F.array(*[F.lit(float(whole[f"w{i}"] + 1)) for i in range(n)])
    rows = scan
    for field in ("declared", "suffix", "domain", "host"):
        rows = rows.join(votes(scan, field, n), field, "left")  # a hot value is split by adaptive execution
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: x / total(a))
    own = lambda v: F.transform(v, lambda x, i: F.when((i == F.col("by_text")) & (F.col("n") > 0), x - 1).otherwise(x))
    below = lambda counts, above: F.zip_with(counts, share(above), lambda x, p: x + strength * p)
    rows = rows.withColumn("whole", base)
    rows = rows.withColumn("at_domain", F.when(F.col("v_domain").isNull(), F.col("whole")).otherwise(below(own(F.col("v_domain")), F.col("whole"))))
    rows = rows.withColumn("at_host", F.when(F.col("v_host").isNull(), F.col("at_domain")).otherwise(below(own(F.col("v_host")), F.col("at_domain"))))
    prior = F.transform(share(F.col("at_host")), lambda x: F.log(x))
    text = F.transform("scores", lambda x: x * F.least(F.col("n").cast("double"), F.lit(most_evidence)))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    # a page's own count tells nothing about itself
    seen = lambda f: F.when(F.col(f"v_{f}").isNull(), F.transform("scores", lambda x: F.lit(0.0))).otherwise(F.zip_with(own(F.col(f"v_{f}")), shown[f], lambda c, t: F.log((c + smooth) / t)))
    rows = rows.withColumn("log_p", plus(plus(prior, text), plus(seen("declared"), seen("suffix"))))
    top = F.array_max("log_p")
    names = F.array(*map(F.lit, languages))
    at = F.array_position("log_p", top).cast("int")
    return rows.select(
        "page_id", F.element_at(names, at).alias("lang"),
        F.round(1 / total(F.transform("log_p", lambda x: F.exp(x - top))), 6).alias("confidence"),
        F.when(F.col("n") > 0, F.element_at(names, F.col("by_text") + 1)).alias("by_text"), "declared", "suffix", "host")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
