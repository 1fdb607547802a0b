"""Substring deduplication by level-wise doubling.

Level 0 is half a window (of 13 words: 7). Of each window its least half-window (by hash) is an anchor, so equal windows
have equal anchors. Anchors that occur in one document alone end there; windows around the others give both their
halves, and of these the ones found in two documents or more survive. From there on survivors double: a window of
length 2L is a candidate where those of length L at its start and at its middle both survive, its hash is that of
the two halves, and candidates found in two documents or more are the survivors of the next level. The first doubling ends
at the window itself, so halves of an odd window share a word. The loop ends when no candidate survives or at the
length asked for. A word is removed if a window (of the full length) over it also starts in a document with a
smaller id, so removal needs no level above that length.

Of equal texts only the one with the least id is searched; the others go whole. Which anchors and windows survive,
and which documents lose words, is told to the tasks by bit tables of bounded size: when they fill up, more windows
or texts than needed are exchanged, the result stays the same.

Windows are compared by 128-bit hashes (anchors and halves by 64 bits, which can only add candidates). Null texts count
as empty. A row with a null id removes nothing and nothing is removed from it. Rows that repeat an id are
judged each by its own text, never against one another. Texts are taken whole,
an empty table gives an empty one, and other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.shared import MULTIPLIERS, bit_table, bounded_batches, durable, in_groups, mixed, parted, texts_of, without, word_hashes

#: Stands for the starts of all windows of a text.
WHOLE = -1


def flat_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, of, starts) of the words of all texts in a row: hash, number of the text, place within it."""
    split = [(text or b"").split() for text in texts]
    many = np.fromiter(map(len, split), np.int64, len(split))
    of = np.repeat(np.arange(len(split)), many)
    return word_hashes([w for words in split for w in words]), of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)


def next_length(length: int, window: int) -> int:
    """Twice the length; half a window and the window itself are not stepped over."""
    half = -(-window // 2)
    return min(2 * length, half if length < half else window) if length < window else 2 * length


def doubled_hashes(hashes: np.ndarray, length: int, window: int, which: int = 0) -> np.ndarray:
    """A hash for each run of ``length`` consecutive words, made of those of its two halves; empty with fewer words."""
    at = 1
    while at < length and len(hashes):
        step = next_length(at, window) - at
        with np.errstate(over="ignore"):
            hashes = mixed(hashes[: max(0, len(hashes) - step)] * MULTIPLIERS[which] + hashes[step:])
        at += step
    return hashes


def least_of(values: np.ndarray, many: int) -> np.ndarray:
    """For each run of ``many`` consecutive values the least one."""
    at = 1
    while at < many and len(values):
        step = min(at, many - at)
        values = np.minimum(values[: max(0, len(values) - step)], values[step:])
        at += step
    return values


def whole(of: np.ndarray, length: int) -> np.ndarray:
    """Which runs of ``length`` consecutive words lie in one text."""
    return of[: max(0, len(of) - length + 1)] == of[length - 1 :]


def scans(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """flat_words of the batch's texts in groups of bounded size, with the number of the first."""
    done = 0
    for texts in in_groups(texts_of(batch)):
        yield done, *flat_words(texts)
        done += len(texts)


def hashed(docs: DataFrame, window: int, table=None) -> DataFrame:
    """hash, doc_id: the anchors of each document; with a bit table of anchors both halves of the windows around these."""
    half = -(-window // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, of, _ in scans(batch):
                grams = doubled_hashes(words, half, window)
                inside = whole(of, window)
                least = least_of(grams, window - half + 1)
                if table is None:
                    same = (least[1:] == least[:-1]) & (of[1 : len(least)] == of[: max(0, len(least) - 1)]) & inside[:-1]
                    at = np.flatnonzero(inside & ~np.concatenate([[False], same])[: len(least)])
                    values = least[at]
                else:
                    keep = np.flatnonzero(inside)
                    keep = keep[table.value.has(least[keep].view(np.int64))]
                    have = np.zeros(len(grams), bool)
                    have[keep] = have[keep + window - half] = True
                    at = np.flatnonzero(have)
                    values = grams[at]
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), batch.column("doc_id").take(pa.array(first + of[at]))], ["hash", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "hash bigint, doc_id bigint")


def shared(hashes: DataFrame) -> DataFrame:
    """hash: those (of hash, doc_id) found in two documents or more."""
    return hashes.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("hash")


def doubled(docs: DataFrame, length: int, step: int, window: int, table) -> DataFrame:
    """h1, h2, doc_id, row_key, start: the windows of ``length`` + ``step`` words of docs(doc_id, row_key, text) whose halves of
    ``length`` words, at their start and ``step`` words on, are both in the bit table."""
    names = ["h1", "h2", "doc_id", "row_key", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, of, starts in scans(batch):
                halves = doubled_hashes(words, length, window)
                there = table.value.has(halves.view(np.int64))
                at = np.flatnonzero(there[: max(0, len(there) - step)] & there[step:] & whole(of, length + step))
                if len(at):
                    h1, h2 = (doubled_hashes(words, length + step, window, k)[at].view(np.int64) for k in (0, 1))
                    row = pa.array(first + of[at])
                    yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column("doc_id").take(row), batch.column("row_key").take(row), pa.array(starts[at].astype(np.int32))], names)

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, row_key bigint, start int")


def repeated(candidates: DataFrame) -> DataFrame:
    """Candidates found in two documents or more, with the least of these (``least``)."""
    same = W.partitionBy("h1", "h2")
    return candidates.withColumns({"least": F.min("doc_id").over(same), "most": F.max("doc_id").over(same)}).where("least <> most").drop("most")


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and row_key, which tells rows with one id apart."""
    bounded_batches(docs)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.withColumn("row_key", F.xxhash64("text"))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, row_key of rows whose very text a smaller id has too; docs from with_key()."""
    rows = docs.where("doc_id is not null").select("doc_id", "row_key", F.md5("text").alias("text"))
    least = rows.groupBy("text").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")
    return rows.join(least, "text").where("doc_id > least").select("doc_id", "row_key")


def repeat_levels(docs: DataFrame, window: int = 13, until: int | None = None, skip: DataFrame | None = None) -> list[tuple[int, DataFrame]]:
    """(length, survivors) of each level until none survives, or to the length ``until``.

    Survivors have h1, h2, doc_id, row_key, start, least. Rows in ``skip`` (doc_id, row_key) are left out.
    """
    docs = with_key(docs).where("doc_id is not null")
    rows = docs if skip is None else without(docs, skip)

    def told(hashes: DataFrame):
        return docs.sparkSession.sparkContext.broadcast(bit_table(durable(hashes, "substring-survivors")))

    length = -(-window // 2)
    around = told(shared(hashed(rows, window)))
    table = told(shared(hashed(rows, window, around)))
    around.destroy()
    levels, step = [], window - length
    while True:
        level = durable(repeated(doubled(rows, length, step, window, table)), "substring-level")
        table.destroy()
        if level.isEmpty():
            return levels
        length += step
        levels.append((length, level))
        if until is not None and 2 * length > until:
            return levels
        table, step = told(level.select("h1").distinct()), length


def without_words(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """With each batch of (text, starts): words, and the words that stay, of each text."""
    for batch in batches:
        out = []
        for text, starts in zip(texts_of(batch), batch.column("starts"), strict=True):
            words = (text or b"").split()
            if not starts.is_valid:
                out.append((len(words), words))
                continue
            cover = np.zeros(len(words) + 1, np.int64)
            at = starts.values.to_numpy()
            if len(at) and at[0] == WHOLE:
                out.append((len(words), words if len(words) < window else []))
                continue
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            keep = np.cumsum(cover[:-1]) == 0
            out.append((len(words), [w for w, k in zip(words, keep.tolist(), strict=True) if k]))
        yield batch, out


def marked(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, text, starts (of the windows to remove; null for none, WHOLE for all) for each row of docs."""
    rows = with_key(docs)
    same = durable(copies(rows), "substring-copies")
    levels = repeat_levels(docs, window, window, same)
    spots = same.distinct().select("doc_id", "row_key", F.array(F.lit(WHOLE)).alias("starts"))
    if levels:
        found = levels[0][1].where("least < doc_id").groupBy("doc_id", "row_key").agg(F.collect_set("start").alias("starts"))
        spots = spots.union(found)
    spots = durable(spots, "substring-spots")
    sure, maybe = parted(rows, spots)
    rest = sure.select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"))
    return rest.union(maybe.join(spots, ["doc_id", "row_key"], "left").select("doc_id", "text", "starts"))


def deduplicated(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, text: the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in without_words(batches, window):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b" ".join(k).decode() for _, k in out], pa.string())], ["doc_id", "text"])

    return marked(docs, window).mapInArrow(run, "doc_id bigint, text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = 13

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in without_words(batches, window):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in out], pa.int64()), pa.array([n - len(k) for n, k in out], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for _, k in out], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return marked(docs, window).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
