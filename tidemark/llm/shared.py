"""What the text operators share: scratch tables, words, hashes, components.

Words are maximal runs of characters other than blank, tab, line feed, vertical
tab, form feed and carriage return (``bytes.split`` with no argument splits at
exactly these six).
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Characters between words, for Java regular expressions and ``trim``.
BLANKS = r"[\x20\x09-\x0D]+"
#: A process keeps at most so many words in a cache; a full cache starts anew.
CACHE_WORDS = 150_000


#: Rows that go to a Python worker at a time: texts are long, and a worker holds a batch more than once.
BATCH_ROWS = 250


def bounded_batches(df: DataFrame) -> None:
    """Lets the session hand Python at most BATCH_ROWS rows at a time."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is taken.
    """
    context = spark.sparkContext
    there = context._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Spark's own setting for a query's shuffle files to go when it has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors.

    Nothing reads the shuffle files of the write again, so they go with its end and not when the driver's memory is tidied:
    steps that follow one another take the disk of the largest, not of all.
    """
    path, conf = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(SHUFFLES_GO)
        else:
            conf.set(SHUFFLES_GO, before)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._scratch_path = path
    return again


def discard(df: DataFrame) -> None:
    """Removes the files of a durable table that nothing reads any more."""
    if path := getattr(df, "_scratch_path", None):
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class HashCache(dict):
    """word -> 64-bit hash, remembered up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@functools.cache
def hash_cache() -> HashCache:
    return HashCache()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash_cache().__getitem__, words), np.uint64, len(words))


#: Odd multipliers for rolling hashes over word hashes.
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash for each window of n consecutive words; empty with fewer than n words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * MULTIPLIERS[which] + hashes[k : len(hashes) - n + 1 + k]
        return mixed(out)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A column's texts as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def in_groups(texts: list, most_bytes: int = 2_000_000) -> Iterator[list]:
    """The texts in order, in lists of at most so many bytes (a longer text makes its own): bounds what words take."""
    group, size = [], 0
    for text in texts:
        n = len(text or b"")
        if group and size + n > most_bytes:
            yield group
            group, size = [], 0
        group.append(text)
        size += n
    if group:
        yield group


def summed(blocks: DataFrame, tasks: int, kind: type = np.int64, plus: np.ufunc = np.add) -> DataFrame:
    """Adds the arrays (counts) that tasks made of each block, first in groups of about sqrt(tasks) tasks, then over these."""

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in rows:
            for x in batch.column("counts").to_pylist():
                part = np.frombuffer(x, kind)
                total = part if total is None else plus(total, part)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "task", "counts"])

    schema = "block int, task int, counts binary"
    groups = max(1, int(tasks**0.5))
    part = blocks.withColumn("task", F.pmod("task", F.lit(groups)))
    if groups > 1:
        part = part.select("block", "task", "counts").groupBy("block", "task").applyInArrow(add, schema).withColumn("task", F.lit(0))
    return part.select("block", "task", "counts").groupBy("block", "task").applyInArrow(add, schema)


class BitTable:
    """Flags of 64-bit ids, packed: an id that was put in is always found, another one seldom."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.size = packed, np.uint64(8 * len(packed))

    def __contains__(self, id_: int) -> bool:
        return bool(self.has(np.array([id_], np.int64))[0])

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = mixed(ids.astype(np.int64).view(np.uint64)) % self.size
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


#: Bytes of a bit table that travel together, and the most bits of a table (16 MB).
BIT_BLOCK, MOST_BITS = 8192, 27


def bit_table(ids: DataFrame) -> BitTable:
    """A table that has the bit of every id set; ids is a single column of a durable table, which is counted first.

    There are 16 flags or more for an id up to 2**MOST_BITS flags; a table that fills up beyond that lets more
    ids through than were put in, and what reads it checks them anyway.
    """
    bits = min(MOST_BITS, max(19, (16 * ids.count()).bit_length()))
    size = 1 << bits - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(size, np.uint8)
        for batch in batches:
            at = np.unique(mixed(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(8 * size))
            np.bitwise_or.at(have, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        blocks = have.reshape(-1, BIT_BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "have"])

    whole = ids.mapInArrow(run, "block int, have binary").groupBy("block").applyInArrow(united, "block int, have binary")
    out = np.zeros((size // BIT_BLOCK, BIT_BLOCK), np.uint8)
    for row in whole.toLocalIterator():
        out[row.block] = np.frombuffer(row.have, np.uint8)
    return BitTable(out.reshape(-1))


def united(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in rows:
        for x in batch.column("have").to_pylist():
            part = np.frombuffer(x, np.uint8)
            total = part if total is None else total | part
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "have"])


def keyed(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns, whatever their names), doc_id, row_key (tells rows with one id apart), text (never null)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))


def parted(rows: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(doc_id, row_key, ...) in two parts: rows that cannot be in the durable some(doc_id, row_key), and those that may be.

    Only the second part has to be joined with ``some``; the first, with its texts, stays where it is.
    """
    table = rows.sparkSession.sparkContext.broadcast(bit_table(some.select(F.xxhash64("doc_id", "row_key").alias("key"))))

    @F.arrow_udf("boolean")
    def may(key: pa.Array) -> pa.Array:
        return pa.array(table.value.has(key.to_numpy(zero_copy_only=False)))

    hit = may(F.xxhash64("doc_id", "row_key"))
    return rows.where(~hit), rows.where(hit)


def joined_rows(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """rows(doc_id, row_key, ...) joined with some(doc_id, row_key, ...); a null id equals a null id."""
    right = some.withColumnsRenamed({"doc_id": "some_id", "row_key": "some_key"})
    on = rows["doc_id"].eqNullSafe(F.col("some_id")) & (rows["row_key"] == F.col("some_key"))
    out = rows.join(right, on, how)
    return out if "anti" in how or "semi" in how else out.drop("some_id", "some_key")


def without(rows: DataFrame, some: DataFrame) -> DataFrame:
    """rows whose (doc_id, row_key) is not in the durable ``some``."""
    sure, maybe = parted(rows, some)
    return sure.unionByName(joined_rows(maybe, some, "left_anti"))


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", salts: int = 16) -> DataFrame:
    """left join right on key, where right has one row a key and left may hold a third of its rows in one key.

    Rows of left are dealt over ``salts`` copies of right's row; no row is dropped.
    """
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c, t in left.dtypes if t in ("bigint", "int", "string")]), F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return spread.join(copies, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that can be reached.

    Alternating large-star and small-star steps, each two aggregations and joins, until a round changes nothing;
    the edge list goes to a durable table after each round, and counts observed while it is written tell whether
    it changed. A hub's edges are never gathered: its minimum is an aggregate, and the join with it is one that
    adaptive execution can split. Rows with a null end or equal ends are ignored.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(e.select(F.col("b"), F.col("a"))) if large else both
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least, "u")
        if large:  # neighbours above u hang on the least neighbour
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:  # u and its lower neighbours hang on the least of them
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return out.where("a <> b").distinct()

    def kept(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = durable(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        return out, (seen.get["n"], seen.get["sum"])

    e, before = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while before[0]:
        nxt, now = kept(step(step(e, True), False))
        discard(e)
        e = nxt
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
