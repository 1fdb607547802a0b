"""Quality rules whose cutoffs are certified on labelled holdouts.

Every document gets the counts of ``BASE`` and ratios of ``FEATURES`` (larger is worse). Labelled
documents are dealt by a hash of their id into a fitting and a holdout half. Within a stratum (the
declared language) the fitting half alone makes one sequence of joint rules, each of which has a cutoff at
most for each feature and rejects all that the rule before rejects: from no rule on, the cutoffs of all
features are let down in the order of bad documents won for each good one lost (concave hulls). On the
holdout documents labelled good, the exact binomial test of "the joint rule's false rejection rate is above
``max_rejection``" is made in that order, up to the first that does not reject (fixed sequence), so a stratum
needs no correction for the number of rules or features; of the rules passed the last that wins bad documents of the
fitting half is taken. The level is ``error`` divided by the number of
strata tested; a stratum is tested if it has enough good holdout documents to pass without any rejection. All
features together reject falsely at most ``max_rejection`` of good documents in each stratum, with probability
1 - ``error``.

Null texts count as empty, a null language is the stratum ''. Documents of a stratum without a safe cutoff, or
without labels, are judged by the base rules alone. Of repeated labels the worst counts, repeated rows are judged
each, values that tie with a cutoff are kept, and an empty table on either side gives no cutoff. Other columns are
not looked at, whatever their names. The number of strata has no bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import bounded_batches, durable, texts_of

#: Ratios that rules can cut, larger is worse.
FEATURES = ("symbols", "dup_lines", "repeats", "shouting", "capitals", "wordless", "long_words")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
ASCII_BLANKS = b" \t\n\x0b\x0c\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words in windows of ``window`` words that are found twice or more in this text.

    Ranks of windows double exactly (1, 2, 4, ... words), so no hash can collide.
    """
    n = len(words)
    if n <= window:
        return 0
    first: dict[bytes, int] = {}
    ranks = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
    if len(first) == n:
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        pairs = ranks[: len(ranks) - step] * np.int64(n + 1) + ranks[step:]
        distinct, ranks = np.unique(pairs, return_inverse=True)
        length += step
        if len(distinct) == len(ranks):
            return 0
    again = np.bincount(ranks)[ranks] > 1
    cover = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measured(text: bytes | None) -> tuple:
    """COUNTS, then FEATURES."""
    text = text or b""
    words = text.split()
    n = len(words)
    solid = text.translate(None, ASCII_BLANKS)
    chars = len(solid.translate(None, CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper, lower = len(text) - len(text.translate(None, UPPER)), len(text) - len(text.translate(None, LOWER))
    return (
        n, chars, symbols, dup, repeats,
        symbols / max(n, 1), dup / max(len(lines), 1), repeats / max(n, 1), text.count(b"!") / max(n, 1),
        upper / max(upper + lower, 1), 1 - (upper + lower) / max(len(solid), 1), chars / max(n, 1),
    )


def features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, COUNTS and FEATURES of each document's whole text; with ``carry`` also the whole row as _row."""
    bounded_batches(docs)
    types = [*((c, pa.int64()) for c in COUNTS), *((c, pa.float64()) for c in FEATURES)]
    held = ["doc_id", "lang", *["_row"] * carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(measured, texts_of(batch)), strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*map(batch.column, held), *(pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True))], [*held, *(n for n, _ in types)])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *[row] * carry)
    kinds = [*((c, T.LongType()) for c in COUNTS), *((c, T.DoubleType()) for c in FEATURES)]
    schema = T.StructType([*(rows.schema[c] for c in held), *(T.StructField(c, t) for c, t in kinds)])
    return rows.mapInArrow(run, schema)


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def binomial_tail(k: int, n: int, rate: float) -> float:
    """P(X <= k) for X binomial(n, rate): the exact p-value of "the true rate is above ``rate``"."""
    if k >= n:
        return 1.0
    if k > n * rate:  # no rejection is possible, and the sum may be long
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def hull(points: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """(cutoff, good lost, bad won) on the upper concave hull from (0, 0), strictest first."""
    out: list[tuple[float, int, int]] = []
    for p in sorted(points, key=lambda x: (x[1], -x[2], -x[0])):
        if p[2] <= (out[-1][2] if out else 0):
            continue
        while out:
            before = out[-2] if len(out) > 1 else (0.0, 0, 0)
            if (out[-1][2] - before[2]) * (p[1] - out[-1][1]) > (p[2] - out[-1][2]) * (out[-1][1] - before[1]):
                break
            out.pop()
        out.append(p)
    return out


def sequence(proposals: dict[str, list[tuple[float, int, int]]]) -> list[tuple[str, float]]:
    """The steps (feature, cutoff) of a stratum's joint rules in the order of bad documents won for each good one lost."""
    steps = []
    for feature, points in proposals.items():
        good = bad = 0
        for place, (cutoff, lost, won) in enumerate(hull(points)):
            steps.append(((lost - good) / (won - bad), feature, place, cutoff))
            good, bad = lost, won
    return [(feature, cutoff) for _, feature, _, cutoff in sorted(steps)]


def cutoffs(measures: DataFrame, labels: DataFrame, max_rejection: float = 0.01, error: float = 0.05, grid: int = 24) -> DataFrame:
    """stratum, feature, cutoff, n_good, n_false, bad_found, p_value: the chosen cutoffs, with figures of their joint rule.

    A stratum without any has one row with a null feature. The driver gets counts: ``grid`` rows at most for each
    stratum and feature, whatever the number of documents.
    """
    spark = measures.sparkSession
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measures.where(~base_failed()).withColumn("stratum", F.coalesce("lang", F.lit(""))).join(known, "doc_id")
    rows = rows.withColumn("fit", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    rows = durable(rows.select("stratum", "fit", (F.col("quality") == 1).alias("good"), *FEATURES), "quality-labelled")
    long = rows.where("fit").select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("x")).select("stratum", "good", "x.*")
    steps = [1 - 0.5 ** (i / 2) for i in range(2, grid + 2)]  # proposals crowd towards the top
    proposals = long.groupBy("stratum", "feature").agg(F.expr(f"percentile_approx(value, array({', '.join(map(str, steps))}), 10000)").alias("cuts"))
    tried = long.join(proposals, ["stratum", "feature"]).select("stratum", "feature", "good", "value", F.explode(F.array_distinct("cuts")).alias("cutoff"))
    hit = F.col("value") > F.col("cutoff")
    points: dict[str, dict[str, list[tuple[float, int, int]]]] = {}
    for r in tried.groupBy("stratum", "feature", "cutoff").agg(F.count_if(F.col("good") & hit).alias("lost"), F.count_if(~F.col("good") & hit).alias("won")).collect():
        points.setdefault(r.stratum, {}).setdefault(r.feature, []).append((r.cutoff, r.lost, r.won))
    paths = {stratum: sequence(p) for stratum, p in points.items()}

    # the first step of its stratum that rejects a document
    table = spark.createDataFrame([(s, [(FEATURES.index(f) + 1, c, i) for i, (f, c) in enumerate(path)]) for s, path in paths.items()], "stratum string, path array<struct<feature: int, cutoff: double, step: int>>")
    values = F.array(*FEATURES)
    hits = F.filter("path", lambda x: F.element_at(values, x["feature"]) > x["cutoff"])
    step = F.array_min(F.transform(hits, lambda x: x["step"]))
    counts: dict[str, dict[tuple, int]] = {}
    for r in rows.join(table, "stratum", "left").groupBy("stratum", "fit", "good", step.alias("step")).count().collect():
        counts.setdefault(r.stratum, {})[r.fit, r.good, r.step] = r["count"]

    n_good = {s: sum(n for (fit, good, _), n in c.items() if good and not fit) for s, c in counts.items()}
    able = sorted((s for s in n_good if paths.get(s)), key=lambda s: (-n_good[s], s))
    tests = max((k for k, s in enumerate(able, 1) if binomial_tail(0, n_good[s], max_rejection) <= error / k), default=0)
    tested = set(able[:tests])
    out = []
    for stratum, c in counts.items():
        found: dict[str, float] = {}
        taken: dict[str, float] = {}
        n_false = bad_found = 0
        best = None
        for i, (feature, cutoff) in enumerate(paths[stratum] if stratum in tested else []):
            n_false += c.get((False, True, i), 0)
            p_value = binomial_tail(n_false, n_good[stratum], max_rejection)
            if p_value > error / tests:
                break
            found[feature] = cutoff
            if won := c.get((True, False, i), 0):  # steps at the end that win nothing are not taken
                bad_found += won
                taken, best = dict(found), (n_good[stratum], n_false, bad_found, p_value)
        out += [(stratum, feature, float(cutoff), *best) for feature, cutoff in taken.items()] or [(stratum, *[None] * 6)]
    return spark.createDataFrame(out, "stratum string, feature string, cutoff double, n_good bigint, n_false bigint, bad_found bigint, p_value double")


def judged(measures: DataFrame, chosen: DataFrame) -> DataFrame:
    """measures with base_failed, kept and failed_rules (names of the features cut)."""
    rules = durable(chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "cutoff")))).alias("cuts")), "quality-cuts")  # bounded: a row a stratum
    rows = measures.withColumn("stratum", F.coalesce("lang", F.lit(""))).join(rules, "stratum", "left")
    failed = F.filter(F.array(*[F.when(F.col(f) > F.col("cuts")[f], F.lit(f)) for f in FEATURES]), lambda x: x.isNotNull())
    rows = rows.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.coalesce(failed, F.array().cast("array<string>")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("cuts")


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Each document's counts and verdict; see the module for the method."""
    measures = durable(features(docs), "quality-measures")
    return judged(measures, cutoffs(measures, labels, **options))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))
