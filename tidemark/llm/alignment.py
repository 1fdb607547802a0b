"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and in how many documents each pair does.

Both tokenizers cut the same bytes (a blank and the text), so byte offsets align them: positions where both end cut the
tokens into groups, and each stretch between two ends of either side is a link of one token with another.

Pairs are counted by spilling. A task gathers (pair, document) records, sorts them by radix (a hash of the first side's
id) and pair, and writes a run a radix: zstd blobs of the distinct pairs with their counts, and of the documents. Runs
are rows of a table in the shared folder, so a lost executor costs no more than its own. A heap merges the runs of a
radix, in two levels: first parts of at most ``PART_BYTES``, so that a hot id fills no task, then the parts. A radix holds
all pairs of its first ids in their order, so the second merge knows each id's highest count when its pairs end. Counts
then stream past the runs again, each of which gives its documents their sums; sums meet by run number.

Each row is a document, so repeated ids and rows count each, also null ids. Texts that are null, empty, or whose bytes
a tokenizer does not give back have no tokens: zeros and an empty string. Texts are never cut, an empty table gives an empty
one, and other columns are not read, whatever their names. Equally high counts are all the highest.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, durable, in_groups, texts_of

#: Records and documents that a task gathers before it writes runs.
RUN_RECORDS, RUN_DOCS = 1 << 20, 1 << 16
#: Bytes of blobs that one merge opens, and pairs in a blob that a merge writes.
PART_BYTES, CHUNK = 16 << 20, 1 << 16
#: How byte-level tokenizers cut a text (fixed pattern), and the characters on which all Unicode versions agree.
CUTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KNOWN = regex.compile("[\\t\\n\\r\\x20-\\x7e\\xa0-ͷЀ-ԓ‐-‧‰-⁞€]*+")


def parts_below(token: bytes, ranks: dict[bytes, int], rank: int) -> list[bytes]:
    """What merges of a lower rank make of a token's bytes: the best one first, the leftmost at a tie."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
        if best >= rank:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def byte_of_char() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both tokenizers with the bytes of each token."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_of_char()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in names]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        size = max(len(self.bytes_a), len(self.bytes_b))
        self.shown = [f"{i}{mark}" for i in range(size) for mark in ",|;"]
        self.quick = self.by_rank(spec)

    def by_rank(self, spec: dict):
        """The first side as a table of ranks, if that is the same tokenizer, else nothing.

        It is where texts are cut at CUTS alone and each merge makes the next id from exactly the two parts that the
        merges before it leave of its bytes: then bytes that can become a token become it by that merge only.
        """
        import tiktoken

        model = spec["model"]
        cut = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if spec["pre_tokenizer"] != cut or spec["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return None
        chars = byte_of_char()
        ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if all(c in chars for c in token)}
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {token: i for token, i in ranks.items() if i not in special}
        for i, pair in enumerate(model["merges"]):
            first, second = (bytes(chars[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            if ranks.get(first + second) != 256 + i or parts_below(first + second, ranks, 256 + i) != [first, second]:
                return None
        if len(ranks) != 256 + len(model["merges"]):
            return None
        return tiktoken.Encoding("first side", pat_str=CUTS.pattern, mergeable_ranks=ranks, special_tokens={})

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of the first side, by ranks where a text has no character that libraries may class differently."""
        known = [self.quick is not None and KNOWN.fullmatch(t) is not None for t in texts]
        others = iter(self.a.encode_batch_fast([t for t, k in zip(texts, known, strict=True) if not k], add_special_tokens=False))
        return [self.quick.encode_ordinary(t) if k else next(others).ids for t, k in zip(texts, known, strict=True)]

    def encoded(self, texts: list[bytes | None]) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """Places of the texts that both sides give back byte for byte, with the ids of both sides."""
        at = [i for i, t in enumerate(texts) if t]
        left = self.ids_a([f" {texts[i].decode()}" for i in at])
        right = self.b.encode([texts[i].decode() for i in at], num_threads=1)
        good = [
            k for k, i in enumerate(at)
            if b"".join(map(self.bytes_a.__getitem__, left[k])) == b" " + texts[i] and b"".join(map(self.bytes_b.__getitem__, right[k])) == b" " + texts[i]
        ]
        return [at[k] for k in good], [left[k] for k in good], [right[k] for k in good]


@functools.cache
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def aligned_ids(both: Sides, left: list[list[int]], right: list[list[int]]) -> tuple[np.ndarray, ...]:
    """Per text numbers of groups and links and the groups in text form; of all texts together each link's text, id and id."""
    n = len(left)
    a = np.fromiter(itertools.chain.from_iterable(left), np.int64)
    b = np.fromiter(itertools.chain.from_iterable(right), np.int64)
    of_a, of_b = (np.repeat(np.arange(n), [len(x) for x in s]) for s in (left, right))
    ends_a, ends_b = np.cumsum(both.len_a[a]), np.cumsum(both.len_b[b])
    marks = np.zeros(int(ends_a[-1]) + 1, np.uint8)
    marks[ends_a] = 1
    marks[ends_b] |= 2
    ends = np.flatnonzero(marks)
    kind = marks[ends]
    link_a = np.cumsum(kind & 1) - (kind & 1)
    link_b = np.cumsum(kind >> 1) - (kind >> 1)
    text = of_a[link_a]
    common = kind == 3
    groups, links = np.bincount(text[common], minlength=n), np.bincount(text, minlength=n)
    # in text form tokens of both sides alternate by group, each with the mark behind it
    last_a, last_b = marks[ends_a] == 3, marks[ends_b] == 3
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    place_a = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(size_a)[group_b]
    written = np.empty(len(a) + len(b), np.int64)
    written[place_a] = 3 * a + last_a
    written[place_b] = 3 * b + 2 * last_b
    cuts = np.append(0, np.cumsum(np.bincount(of_a, minlength=n) + np.bincount(of_b, minlength=n))).tolist()
    shown = ["".join(map(both.shown.__getitem__, written[i:j].tolist()))[:-1] for i, j in itertools.pairwise(cuts)]
    return groups, links, shown, text, a[link_a], b[link_b]


def runs_of(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return first, np.diff(np.append(first, len(sorted_)))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as a zstd blob, byte planes apart; the first as differences."""
    planes = []
    for k, x in enumerate(columns):
        x = np.diff(x, prepend=x.dtype.type(0)) if k == 0 else x
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, (kind, size) in enumerate(zip(kinds, sizes, strict=True)):
        x = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n)
        out.append(np.cumsum(x, dtype=kind) if k == 0 else x)
        at += n * size
    return out


def radix_of(first: np.ndarray, radices: int) -> np.ndarray:
    x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(radices)).astype(np.int64)


#: A pair is one number: the first id above the second.
PAIR_BITS, PAIR_MASK = 24, (1 << 24) - 1

SCANNED = "run bigint, radix int, place int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, docs binary"
SCANNED_ARROW = pa.schema([("run", pa.int64()), ("radix", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("pairs", pa.binary()), ("docs", pa.binary())])


def scanned(docs: DataFrame, path_a: str, path_b: str, radices: int, digests: bool, run_records: int) -> DataFrame:
    """One pass over the texts: a row a document (radix null), and rows of runs (radix, pairs, docs)."""

    def written(**columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in SCANNED_ARROW], schema=SCANNED_ARROW)

    def spilled(run: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        pair, place, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        radix = radix_of(pair >> PAIR_BITS, radices)
        order = np.lexsort((pair, radix))  # stable, so a pair's documents keep their order
        pair, place, times, radix = pair[order], place[order], times[order], radix[order]
        first, sizes = runs_of(radix)
        out = {"run": [], "radix": [], "pairs": [], "docs": []}
        for i, j in zip(first.tolist(), (first + sizes).tolist(), strict=True):
            at, count = runs_of(pair[i:j])
            out["run"].append(run)
            out["radix"].append(int(radix[i]))
            out["pairs"].append(packed(pair[i:j][at], count.astype(np.int64)))
            out["docs"].append(packed(place[i:j].astype(np.uint16), times[i:j].astype(np.uint32)))
        return written(**out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(path_a, path_b)
        run, n, size, parts = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            ids = iter(batch.column("doc_id").to_pylist())
            for texts in in_groups(texts_of(batch)):
                for begin in range(0, len(texts), 1 << 12):
                    some = texts[begin : begin + (1 << 12)]
                    if n + len(some) > RUN_DOCS or size >= run_records:
                        if parts:
                            yield spilled(run, parts)
                        run, n, size, parts = run + 1, 0, 0, []
                    at, left, right = both.encoded(some)
                    columns = {c: [0] * len(some) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": [""] * len(some)}
                    if at:
                        groups, links, shown, text, a, b = aligned_ids(both, left, right)
                        for k, i in enumerate(at):
                            columns["n_a"][i], columns["n_b"][i] = len(left[k]), len(right[k])
                            columns["n_groups"][i], columns["n_links"][i] = int(groups[k]), int(links[k])
                            columns["groups"][i] = hashlib.sha256(shown[k].encode()).hexdigest() if digests else shown[k]
                        key = np.sort(text << 2 * PAIR_BITS | a << PAIR_BITS | b)  # a text's place takes 12 bits
                        first, times = runs_of(key)
                        key = key[first]
                        parts.append((key & ((1 << 2 * PAIR_BITS) - 1), n + np.array(at)[key >> 2 * PAIR_BITS], times))
                        size += len(key)
                    yield written(run=[run] * len(some), place=list(range(n, n + len(some))), doc_id=list(itertools.islice(ids, len(some))), **columns)
                    n += len(some)
        if parts:
            yield spilled(run, parts)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCANNED)


def parted_runs(runs: DataFrame, blob: str, part_bytes: int) -> DataFrame:
    """runs with a part number: those of one radix are dealt over parts of about part_bytes."""
    sizes = runs.groupBy("radix").agg(F.ceil(F.sum(F.length(blob)) / part_bytes).cast("int").alias("parts"))  # a row a radix
    return runs.join(F.broadcast(sizes), "radix").withColumn("part", F.pmod(F.xxhash64("run"), F.col("parts")).cast("int"))


def merged(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, count) in the order of pairs, from runs that are each in that order: a heap holds each run's next pair."""
    runs = [zip(*(x.tolist() for x in unpacked(blob, np.int64, np.int64)), strict=True) for blob in blobs]
    current, total = -1, 0
    for pair, count in heapq.merge(*runs):
        if pair != current:
            if current >= 0:
                yield current, total
            current, total = pair, 0
        total += count
    if current >= 0:
        yield current, total


def blobs_of(rows: Iterator[pa.RecordBatch]) -> list[bytes]:
    return [x for batch in rows for x in batch.column("pairs").to_pylist()]


def part_counts(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream = merged(blobs_of(rows))
    while chunk := list(itertools.islice(stream, CHUNK)):
        blob = packed(*(np.array(x, np.int64) for x in zip(*chunk, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], ["radix", "pairs"])


def whole_counts(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a first id follow each other, so its highest count is known when they end; no more than them is held."""
    out: list[tuple[int, int, bool]] = []

    def written() -> pa.RecordBatch:
        pair, count, best = zip(*out, strict=True)
        blob = packed(np.array(pair, np.int64), np.array(count, np.int64), np.array(best, np.uint8))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], ["radix", "pairs"])

    for _, of_id in itertools.groupby(merged(blobs_of(rows)), lambda x: x[0] >> PAIR_BITS):
        pairs = list(of_id)
        most = max(n for _, n in pairs)
        out.extend((p, n, n == most) for p, n in pairs)
        if len(out) >= CHUNK:
            yield written()
    if out:
        yield written()


def counted(runs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """radix, pairs: blobs of all pairs of a radix with their number of documents and whether it is their first id's highest."""
    schema = "radix int, pairs binary"
    parts = parted_runs(runs.select("radix", "run", "pairs"), "pairs", part_bytes)
    return parts.select("radix", "part", "pairs").groupBy("radix", "part").applyInArrow(part_counts, schema).groupBy("radix").applyInArrow(whole_counts, schema)


def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by radix and part, counts (no run) before runs: what each run adds to its documents."""
    at, keys, counts, best = None, [], None, None
    for batch in batches:
        out_run, out_blob = [], []
        for radix, run, pairs, docs in zip(*(batch.column(c).to_pylist() for c in ("radix", "run", "pairs", "docs")), strict=True):
            if run is None:
                if radix != at or counts is not None:
                    at, keys, counts = radix, [], None
                keys.append(unpacked(pairs, np.int64, np.int64, np.uint8))
                continue
            if counts is None:
                table = [np.concatenate(x) for x in zip(*keys, strict=True)]
                order = np.argsort(table[0], kind="stable")
                keys, counts, best = table[0][order], table[1][order], table[2][order].astype(np.int64)
            pair, documents = unpacked(pairs, np.int64, np.int64)
            place, times = unpacked(docs, np.uint16, np.uint32)
            found = np.repeat(np.searchsorted(keys, pair), documents)
            times = times.astype(np.int64)
            n_best, total = np.zeros(int(place.max()) + 1, np.int64), np.zeros(int(place.max()) + 1, np.int64)
            np.add.at(n_best, place, best[found] * times)
            np.add.at(total, place, counts[found] * times)
            out_run.append(run)
            out_blob.append(zstandard.ZstdCompressor(level=1).compress(np.concatenate([n_best, total]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(out_run, pa.int64()), pa.array(out_blob, pa.binary())], ["run", "docs"])


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by run, sums (no place) before documents."""
    at, n_best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    for batch in batches:
        keep, first, second = [], [], []
        for i, (run, place, docs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("run", "place", "docs")), strict=True)):
            if run != at:
                at, n_best, total = run, np.zeros(RUN_DOCS, np.int64), np.zeros(RUN_DOCS, np.int64)
            if place is None:
                sums = np.frombuffer(zstandard.ZstdDecompressor().decompress(docs), np.int64).reshape(2, -1)
                n_best[: sums.shape[1]] += sums[0]
                total[: sums.shape[1]] += sums[1]
            else:
                keep.append(i)
                first.append(int(n_best[place]))
                second.append(int(total[place]))
        rows = batch.take(pa.array(keep, pa.int64()))
        columns = {"n_best": pa.array(first, pa.int64()), "count_sum": pa.array(second, pa.int64())}
        yield pa.RecordBatch.from_arrays([columns[c] if c in columns else rows.column(c) for c in names], names)


def scan_runs(docs: DataFrame, path_a: str, path_b: str, digests: bool = False, run_records: int = RUN_RECORDS) -> DataFrame:
    """The durable table of documents and runs; as many radices as the session has shuffle partitions."""
    bounded_batches(docs)
    radices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(scanned(docs, path_a, path_b, radices, digests, run_records), "alignment-runs")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, **options) -> DataFrame:
    """a, b, documents, best: each pair of ids that overlap somewhere, in how many documents, and whether no b of that a is in more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blob in (x for batch in batches for x in batch.column("pairs").to_pylist()):
            pair, count, best = unpacked(blob, np.int64, np.int64, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(pair >> PAIR_BITS), pa.array(pair & PAIR_MASK), pa.array(count), pa.array(best == 1)], ["a", "b", "documents", "best"])

    table = scan_runs(docs, path_a, path_b, **options)
    return counted(table.where("radix is not null")).select("pairs").mapInArrow(rows, "a bigint, b bigint, documents bigint, best boolean")


def aligned(docs: DataFrame, path_a: str, path_b: str, digests: bool = False, run_records: int = RUN_RECORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups in text form (or their SHA-256) of docs(doc_id, text)."""
    table = scan_runs(docs, path_a, path_b, digests, run_records)
    runs = table.where("radix is not null").select("radix", "run", "pairs", "docs")
    counts = durable(counted(runs, part_bytes), "alignment-counts")
    parts = parted_runs(runs, "docs", 4 * part_bytes)
    copies = parts.select("radix", "part").distinct().join(counts, "radix")
    columns = ["radix", "part", "run", "pairs", "docs"]
    rows = parts.select(columns).unionByName(copies.select("radix", "part", F.lit(None).cast("bigint").alias("run"), "pairs", F.lit(None).cast("binary").alias("docs")))
    added = rows.repartition("radix", "part").sortWithinPartitions("radix", "part", F.col("run").asc_nulls_first()).mapInArrow(contributions, "run bigint, docs binary")
    documents = table.where("place is not null").select("run", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    both = documents.unionByName(added, allowMissingColumns=True)
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
    return both.repartition("run").sortWithinPartitions("run", F.col("place").asc_nulls_first()).mapInArrow(finished, schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), digests=True).withColumnRenamed("groups", "groups_sha256")
