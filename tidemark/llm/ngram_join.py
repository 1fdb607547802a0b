"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word n-grams. The global n-gram order is that of the n-grams' scrambled hashes, which
any cut divides into fragments of even mass. Equal sets form one class, and classes are compared:

1. Candidates. Two sets of n and m n-grams that reach the threshold differ in at most D n-grams, where D follows from
   n and m. The order is cut into more than D fragments, so both sets have the very same n-grams in one of them at
   least. One scan of the texts writes each class's set size, a sketch of parities and a signature (64 bits) for each
   fragment. Sizes are divided into ranges so that partners lie in one range or in neighbouring ones; the number of
   fragments belongs to a range, and a set has signatures for its own range and the one below. Some fragments have
   no n-gram of a set and so no signature; there are ``spare`` fragments more than D for that, and a set with more
   empty ones has signatures by a second order as well, and so on: a pair is found by the first order in which one
   of the two has few enough.
2. Stars. Signatures of one class only go; of those with the same classes (equal number, least and greatest class,
   sum of 24 low bits and exclusive or) one is kept. Around each of these, classes are compared with a single leader, the
   class that shares most signatures: copies of one text hang on the copy with the fewest edits. Links make components.
3. Rest. Classes that share a signature but lie in different components are compared too, so no link is lost; what
   their parities, short and long, rule out (they differ in at most D places) goes within the join, so a signature of
   very many unlinked classes gives no rows for all their pairs.

Pairs of sets too large for the long parities are judged by wide ones, of as many bits as the sets have n-grams, before they
are compared, so that few unlinked sets leave their texts. A comparison joins the two sets fragment by fragment, counts the partial overlaps and sums them per pair.

Rows with a null id, without words or without text link with nothing (a null id has a null component).
Rows that repeat an id are judged each by its own text and share the component. Other columns are not looked at,
whatever their names. Long texts are taken whole, an empty table gives an empty one. Leaders with equal weight: the greater class.
Hashes have 64 bits; the chance that two different sets share a class is (number of sets)**2 / 2**65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import bit_table, bounded_batches, components, discard, durable, joined_rows, keyed, mixed, parted, texts_of, window_hashes, word_hashes

#: Words of 64 parity bits for each set: two sets differ in as many n-grams at least as in parities.
PARITY = [f"p{k}" for k in range(4)]
#: Bits of the longer sketch of parities, which tells larger sets apart; sets of more n-grams have a wide one, too.
SKETCH = 2048
#: Mixed into the hashes to get the next global order.
NEXT_ORDER = np.uint64(0xD6E8FEB86659FD93)
#: A task remembers so many classes whose signatures it has written.
REMEMBERED = 100_000
#: Signatures that a task holds at a time while it groups them.
TABLE_ROWS = 500_000
#: Signatures go to disk in so many turns at least, if there are TURN_ROWS for each: a turn's shuffle is a small part of all.
TURNS, TURN_ROWS = 12, 500_000


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """The distinct n-gram hashes, ascending; A-Z count as a-z."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(n, len(words))))


def set_class(hashes: np.ndarray) -> int:
    """A 64-bit class of equal sets."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def parities(hashes: np.ndarray, size: int = 64 * len(PARITY)) -> np.ndarray:
    """Whether an odd number of the set's n-grams falls on each of ``size`` bits, packed into words."""
    return np.packbits(np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1).view(np.int64)


def wide_parities(hashes: np.ndarray) -> np.ndarray | None:
    """Parities in as many bits as there are n-grams (the next power of two); null where SKETCH bits are as many."""
    return parities(hashes, 1 << (len(hashes) - 1).bit_length()) if len(hashes) > SKETCH else None


def fragment(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of the global order in which each n-gram lies."""
    return np.minimum((hashes.astype(np.float64) * (fragments / 2.0**64)).astype(np.int64), fragments - 1)


class SizeRanges:
    """Ranges of set sizes: a set's partners lie in its own range or in a neighbouring one."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append((self.starts[-1]) * 100 // self.percent + 1)
        lo, hi = 0, len(self.starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= size else (lo, mid)
        return lo

    def cut(self, k: int) -> tuple[int, int]:
        """(fragments, spare ones) for the range k and the one above it; no fragment where only equal sets reach the threshold."""
        self.of(self.starts[-1])
        largest = self.starts[k + 1] - 1
        most = largest + largest * 100 // self.percent
        differ = max(s - 2 * -(-self.percent * s // (100 + self.percent)) for s in range(max(2, most - 40), most + 1))
        if differ <= 0:
            return 0, 0
        spare = math.ceil(2 * (differ + 1) * math.exp(-self.starts[k] / (differ + 1)))
        return differ + 1 + spare, spare


class Signatures:
    """The signatures of a set, see the module."""

    def __init__(self, percent: int):
        self.ranges, self.cuts = SizeRanges(percent), {}

    def of(self, hashes: np.ndarray) -> np.ndarray:
        own, out = self.ranges.of(len(hashes)), []
        for k in (own, own - 1):
            if k not in self.cuts:
                self.cuts[k] = self.ranges.cut(k) if k >= 0 else (0, 0)
            fragments, spare = self.cuts[k]
            order, turn = hashes, 0
            while fragments:
                where = fragment(order, fragments)
                begin = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
                with np.errstate(over="ignore"):
                    name = where[begin].astype(np.uint64) * np.uint64(2**20) + np.uint64(k * 64 + turn)
                    out.append(mixed(np.add.reduceat(mixed(order + NEXT_ORDER), begin) ^ mixed(name)))
                    if fragments - len(begin) <= spare:
                        break
                    order, turn = np.sort(mixed(order ^ NEXT_ORDER)), turn + 1
        return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def scanned(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, row_key, n, cls, parities, sigs, sketch and wide sketch of docs(doc_id, row_key, text); the last three are null
    where the task has given the class's already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, seen = Signatures(percent), set()
        for batch in batches:
            sizes, classes, odd, sigs, sketches, wide = [], [], [], [], [], []
            for text, there in zip(texts_of(batch), batch.column("doc_id").is_valid().to_pylist(), strict=True):
                s = shingle_set(text, n)
                cls = set_class(s) if len(s) else None
                sizes.append(len(s))
                odd.append(parities(s))
                classes.append(cls)
                if cls is None or not there or cls in seen:
                    sigs.append(None)
                    sketches.append(None)
                    wide.append(None)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(cls)
                sigs.append(signatures.of(s))
                sketches.append(parities(s, SKETCH))
                wide.append(wide_parities(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), *(pa.array(x) for x in np.array(odd, np.int64).reshape(len(sizes), len(PARITY)).T), pa.array(sigs, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))], names)

    names = ["doc_id", "row_key", "n", "cls", *PARITY, "sigs", "sketch", "wide"]
    return docs.mapInArrow(run, "doc_id bigint, row_key bigint, n bigint, cls bigint, " + ", ".join(f"{p} bigint" for p in PARITY) + ", sigs array<bigint>, sketch array<bigint>, wide array<bigint>")


def signature_rows(scan: DataFrame, table) -> DataFrame:
    """sig, cls, n: the signatures that the bit table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sigs")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            hit = table.value.has(flat)
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[hit]
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), batch.column("cls").take(pa.array(of)), batch.column("n").take(pa.array(of))], ["sig", "cls", "n"])

    return scan.where("sigs is not null").select("cls", "n", "sigs").mapInArrow(run, "sig bigint, cls bigint, n bigint")


def segments(docs: DataFrame, n: int, wanted, fragments: int) -> DataFrame:
    """cls, frag, grams: the fragments of the sets whose documents' ids ``wanted`` (a bit table) lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(wanted.value.has(batch.column("doc_id").to_numpy(zero_copy_only=False)))
            if not len(hit):
                continue
            classes, frags, grams = [], [], []
            for text in texts_of(batch.take(pa.array(hit))):
                s = shingle_set(text, n)
                if not len(s):
                    continue
                cls, where = set_class(s), fragment(s, fragments)
                for part in np.split(np.arange(len(s)), np.flatnonzero(np.diff(where)) + 1):
                    classes.append(cls)
                    frags.append(int(where[part[0]]))
                    grams.append(s[part].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(frags, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], ["cls", "frag", "grams"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "cls bigint, frag int, grams array<bigint>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int, fragments: int) -> DataFrame:
    """a, b: the pairs (a, na, b, nb) whose sets reach the threshold, by partial overlaps of fragments.

    A set that stands in sets more than once gives its overlaps again, of which one counts.
    """
    one = sets.select(F.col("cls").alias("a"), "frag", F.col("grams").alias("ga"))
    two = sets.select(F.col("cls").alias("b"), "frag", F.col("grams").alias("gb"))
    # both joins deal the sets by (class, fragment), so Spark scans and shuffles them once
    each = pairs.withColumn("frag", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))))
    partial = each.join(one, ["a", "frag"]).join(two, ["b", "frag"]).select("a", "b", "na", "nb", "frag", F.size(F.array_intersect("ga", "gb")).alias("part"))
    once = partial.groupBy("a", "b", "na", "nb", "frag").agg(F.max("part").alias("part"))
    both = once.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def spare_grams(percent: int, na: str, nb: str) -> Column:
    """The most n-grams in which linked sets of na and nb n-grams differ."""
    return F.expr(f"{na} + {nb} - 2 * (({percent} * ({na} + {nb}) + {99 + percent}) div {100 + percent})")


def alike(percent: int, na: str = "na", nb: str = "nb", one: str = "{}", two: str = "{}_2") -> Column:
    """Sizes and parities of the sides na, p0.. and nb, p0_2.. (as ``one`` and ``two`` name them) allow the threshold."""
    differ = sum((F.bit_count(F.col(one.format(p)).bitwiseXOR(F.col(two.format(p)))) for p in PARITY), F.lit(0))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ <= spare_grams(percent, na, nb))


def second_parities() -> list[Column]:
    return [F.col(p).alias(f"{p}_2") for p in PARITY]


def sketched(percent: int, na: str = "na", nb: str = "nb", one: str = "{}", two: str = "{}_2") -> Column:
    """The longer sketches of the sides na, sketch and nb, sketch_2 allow the threshold."""
    differ = F.aggregate(F.zip_with(one.format("sketch"), two.format("sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ <= spare_grams(percent, na, nb)


def widely(percent: int) -> Column:
    """The wide sketches of the sides na, wide and nb, wide_2 allow the threshold; true if one has none.

    Of linked sets the one has at most twice the bits of the other, and a sketch's halves xored are the sketch of half its bits.
    """
    words = F.least(F.size("wide"), F.size("wide_2"))

    def folded(name: str) -> Column:
        halves = F.zip_with(F.slice(name, F.lit(1), words), F.slice(name, words + 1, words), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(name) > words, halves).otherwise(F.col(name))

    differ = F.aggregate(F.zip_with(folded("wide"), folded("wide_2"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.col("wide").isNotNull() & F.col("wide_2").isNotNull(), differ <= spare_grams(percent, "na", "nb")).otherwise(F.lit(True))


def across(apart: DataFrame, percent: int) -> DataFrame:
    """a, na, b, nb: the pairs of apart(sig, cls, n, component, parities, sketch) that share a signature, once for each, in
    different components.

    Both kinds of sketches are judged within the join, so it gives pairs near the threshold only and not all that a
    frequent signature brings together; adaptive execution can split it. Both sides have the same columns under the same names,
    so Spark shuffles them, sketches and all, once.
    """
    sides = ("x.n", "y.n", "x.{}", "y.{}")
    met = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.component") < F.col("y.component")) & alike(percent, *sides) & sketched(percent, *sides)
    return apart.alias("x").join(apart.alias("y"), met).select(F.col("x.cls").alias("a"), F.col("x.n").alias("na"), F.col("y.cls").alias("b"), F.col("y.n").alias("nb"))


def grouped(docs: DataFrame, n: int = 5, percent: int = 80, fragments: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, firsts, groups) of docs(doc_id, text[, row_key]), all durable.

    rows: doc_id, row_key, n, cls for each row; firsts: cls, doc_id (least), n, parities for each class that has an
    id; groups: cls, component (a class) for each class that links with another one.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row_key"), text.alias("text"))
    seen = Observation()
    many = F.coalesce(F.sum(F.array_size("sigs")), F.lit(0))
    scan = durable(scanned(docs, n, percent).observe(seen, many.alias("sigs"), F.max(F.spark_partition_id()).alias("last")), "ngram-sets")
    known = scan.where("doc_id is not null and cls is not null")
    firsts = durable(known.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *[F.first(p).alias(p) for p in PARITY]), "ngram-firsts")
    # signatures are grouped before the shuffle, by residues so that no task's table of them grows beyond TABLE_ROWS
    turns = max(-(-seen.get["sigs"] // (((seen.get["last"] or 0) + 1) * TABLE_ROWS)), min(TURNS, seen.get["sigs"] // TURN_ROWS)) or 1
    # groups of classes count as the same by least, greatest and number, a sum (of 24 bits: whole up to 2**39 rows) and an exclusive or
    same = [F.sum(F.col("cls").bitwiseAND(F.lit(2**24 - 1))).alias("sum"), F.bit_xor("cls").alias("mix")]
    each = known.where("sigs is not null").select(F.explode("sigs").alias("sig"), "cls")
    parts = []
    for k in range(turns):
        part = each.where(F.pmod("sig", F.lit(turns)) == k).groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("many"), *same)
        parts.append(durable(part.where("lo <> hi"), "ngram-part"))
    # signatures of the very same classes stand for one another
    common = reduce(DataFrame.union, parts).groupBy("lo", "hi", "many", "sum", "mix").agg(F.min("sig").alias("sig"), F.count("*").alias("times"))
    common = durable(common.select("sig", (F.col("many") * F.col("times")).alias("many")), "ngram-common")
    for part in parts:
        discard(part)
    table = spark.sparkContext.broadcast(bit_table(common.select("sig")))
    shared = durable(signature_rows(known, table).join(common, "sig").distinct(), "ngram-shared")
    table.destroy()
    rows = durable(scan.select("doc_id", "row_key", "n", "cls"), "ngram-rows")
    sketches = durable(known.where("sketch is not null").select("cls", "sketch", "wide"), "ngram-sketches")
    discard(scan)

    def drawn(classes: DataFrame) -> DataFrame:
        """cls, sketch, wide of the classes (one column) and of few others: only these leave the place where they lie."""
        table = spark.sparkContext.broadcast(bit_table(durable(classes.distinct(), "ngram-ends")))

        @F.arrow_udf("boolean")
        def may(cls: pa.Array) -> pa.Array:
            return pa.array(table.value.has(cls.to_numpy(zero_copy_only=False)))

        return durable(sketches.where(may("cls")).dropDuplicates(["cls"]), "ngram-drawn")

    def compared(pairs: DataFrame) -> DataFrame:
        """The links among the durable pairs (a, na, b, nb), by their sets from the texts, of those that the sketches allow."""
        long = drawn(pairs.select("a").union(pairs.select("b")))
        near = pairs.join(long.select(F.col("cls").alias("a"), "sketch", "wide"), "a").join(long.select(F.col("cls").alias("b"), F.col("sketch").alias("sketch_2"), F.col("wide").alias("wide_2")), "b")
        pairs = durable(near.where(sketched(percent) & widely(percent)).select("a", "na", "b", "nb"), "ngram-pairs")
        discard(long)
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        ids = durable(firsts.join(ends, "cls").select("doc_id"), "ngram-wanted")
        wanted = spark.sparkContext.broadcast(bit_table(ids))
        out = durable(linked(pairs, segments(docs, n, wanted, fragments), percent, fragments), "ngram-links")
        wanted.destroy()
        discard(ids)
        return out

    weight = shared.groupBy("cls").agg(F.sum("many").alias("weight"))
    leader = shared.join(weight, "cls").groupBy("sig").agg(F.max_by(F.struct("cls", "n"), F.struct("weight", "cls")).alias("x"))
    stars = shared.join(leader.select("sig", F.col("x.cls").alias("b"), F.col("x.n").alias("nb")), "sig").where("cls <> b").select(F.col("cls").alias("a"), F.col("n").alias("na"), "b", "nb").distinct()
    stars = stars.join(firsts.select(F.col("cls").alias("a"), *PARITY), "a").join(firsts.select(F.col("cls").alias("b"), *second_parities()), "b")
    stars = durable(stars.where(alike(percent)).select("a", "na", "b", "nb"), "ngram-stars")
    links = compared(stars)
    groups = durable(components(links).withColumnRenamed("node", "cls"), "ngram-groups")
    discard(links)

    # what shares a signature across components
    placed = shared.select("sig", "cls", "n").join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    apart = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    apart = durable(placed.join(apart, "sig"), "ngram-placed")
    long = drawn(apart.select("cls"))
    apart = apart.join(firsts.select("cls", *PARITY), "cls").join(long.drop("wide"), "cls").select("sig", "cls", "n", "component", *PARITY, "sketch")
    met = across(apart, percent).distinct()
    turned = stars.select(F.col("b").alias("a"), F.col("a").alias("b"))
    rest = durable(met.join(stars.select("a", "b").union(turned), ["a", "b"], "left_anti").select("a", "na", "b", "nb"), "ngram-rest")
    discard(long)
    more = compared(rest)
    discard(sketches)
    return rows, firsts, regrouped(groups, more)


def regrouped(groups: DataFrame, more: DataFrame) -> DataFrame:
    """groups(cls, component) with the links more(a, b) added."""
    if more.isEmpty():
        return groups
    of = lambda c: groups.select(F.col("cls").alias(c), F.col("component").alias(f"{c}_in"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    wider = components(ends.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    all_ = groups.union(ends.select("a", F.coalesce("a_in", "a"))).union(ends.select("b", F.coalesce("b_in", "b"))).distinct()
    return durable(all_.join(wider, "component", "left").select("cls", F.coalesce("wider", "component").alias("component")), "ngram-groups")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, fragments: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) for each row of docs(doc_id, text)."""
    rows, firsts, groups = grouped(docs, n, percent, fragments)
    # rows that repeat an id lie together
    known = rows.where("doc_id is not null and cls is not null")
    repeated = known.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    groups = regrouped(groups, durable(known.join(repeated, "doc_id").select(F.col("cls").alias("a"), F.col("lo").alias("b")).where("a <> b").distinct(), "ngram-own"))
    # from classes to documents: the least id of a class, then of a component
    of_class = firsts.select("cls", "doc_id").join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_class = of_class.join(least, "component").select("cls", "least")
    out = rows.join(of_class, "cls", "left")  # a class of very many rows is split by adaptive execution
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies, the one with the least (doc_id, hash of the text).

    Rows that repeat id and text count once. Rows that repeat an id with other texts are judged each. Rows with a null
    id stay, as do null and empty texts (but for repeats). All columns stay, whatever their names.
    """
    rows, _, groups = grouped(docs, n, percent)
    known = rows.where("doc_id is not null")
    placed = known.where("cls is not null").join(groups, "cls", "left").select("doc_id", "row_key", F.coalesce("component", "cls").alias("component"))
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    gone = durable(placed.join(first, "component").where(F.struct("doc_id", "row_key") != F.col("first")).select("doc_id", "row_key").distinct(), "ngram-gone")
    again = durable(known.groupBy("doc_id", "row_key").count().where("count > 1").select("doc_id", "row_key"), "ngram-again")
    sure, maybe = parted(keyed(docs), durable(gone.union(again).distinct(), "ngram-looked-at"))
    kept = joined_rows(maybe, gone, "left_anti")
    if not again.isEmpty():
        once = joined_rows(kept, again, "left_semi").dropDuplicates(["doc_id", "row_key"])
        kept = joined_rows(kept, again, "left_anti").unionByName(once)
    return sure.unionByName(kept).select("row.*")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)
