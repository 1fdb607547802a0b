"""Token ids in sorted-string-table shards.

Documents are encoded with the tokenizers library, an end id is appended, and ids go to shards in ascending
document order. A shard file is

    blocks | index | Bloom filter | footer

A block holds entries (bytes shared with the key before, further key bytes, value bytes: varints; key bytes;
value). A key is 13 bytes that sort like the documents: 0 for a null id, else 1; the id, its sign bit flipped, big
endian; an ordinal for rows that repeat an id (in order of their texts). A value is the ids as little-endian
unsigned 16-bit or 32-bit integers. The index has a block's last key, place and length for every block (one for
about ``BLOCK_BYTES`` bytes), so a lookup asks the Bloom filter, finds the block by bisection and reads
that one block. The footer has the places and lengths of index and filter, counts, the integer width and a magic.

With a tokenizer of the kind that ``BY_WORDS`` tells (checked when it is loaded) a text is cut at ASCII blanks,
which no token crosses; each distinct lower-cased word is encoded once by the library and remembered (a bounded
cache). With any other the library gets whole texts. Null texts count as empty and give the end id alone, repeated
rows stand side by side, an empty table gives no shard, and other columns than doc_id and text are not looked at.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import CACHE_WORDS, bounded_batches, durable, in_groups, scratch_dir, texts_of

MAGIC = b"TIDEIDS1"
BLOCK_BYTES = 32 * 1024
FOOTER = struct.Struct("<QIQIQQII8s")  # index at, length; filter at, length; documents, ids; width, probes; magic
BLOOM_BITS, PROBES = 10, 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None, ordinal: int) -> bytes:
    return struct.pack(">BQI", doc_id is not None, (doc_id or 0) + 2**63 if doc_id is not None else 0, ordinal)


def id_of(key: bytes) -> int | None:
    there, value, _ = struct.unpack(">BQI", key)
    return value - 2**63 if there else None


def bloom_places(doc_id: int | None, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key_of(doc_id, 0))
    one, two = h & (2**64 - 1), h >> 64 | 1
    return [(one + i * two) % bits for i in range(PROBES)]


class ShardWriter:
    """Collects one shard, entries in ascending order; only index, filter and the open block are held in memory."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at, self.index = sink, width, 0, []
        self.block, self.last, self.keys, self.ids, self.n = bytearray(), b"", [], 0, 0

    def add(self, doc_id: int | None, ordinal: int, value: bytes) -> None:
        key = key_of(doc_id, ordinal)
        if self.block and len(self.block) + len(value) > BLOCK_BYTES:
            self.flush()
        shared = len(os.path.commonprefix([key, self.last])) if self.block else 0
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(doc_id)
        self.n, self.ids = self.n + 1, self.ids + len(value) // self.width

    def flush(self) -> None:
        if self.block:
            self.sink.write(bytes(self.block))
            self.index.append((self.last, self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for b in bloom_places(k, bits):
                bloom[b >> 3] |= 1 << (b & 7)
        index = b"".join(k + struct.pack("<QI", at, n) for k, at, n in self.index)
        tail = struct.pack("<Q", bits) + bytes(bloom)
        self.sink.write(index + tail + FOOTER.pack(self.at, len(index), self.at + len(index), len(tail), self.n, self.ids, self.width, PROBES, MAGIC))


class ShardReader:
    """Reads a shard from a seekable file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        footer = FOOTER.unpack(self.piece(size - FOOTER.size, FOOTER.size))
        index_at, index_n, bloom_at, bloom_n, self.n, self.ids, self.width, _, magic = footer
        if magic != MAGIC:
            raise ValueError("no shard of token ids")
        raw, step = self.piece(index_at, index_n), 13 + 12
        self.last = [raw[i : i + 13] for i in range(0, index_n, step)]
        self.spots = [struct.unpack("<QI", raw[i + 13 : i + step]) for i in range(0, index_n, step)]
        bloom = self.piece(bloom_at, bloom_n)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def piece(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        data = self.piece(*self.spots[block])
        at, key = 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            more, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, data[at : at + size]
            at += size

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.spots)):
            for key, value in self.entries(block):
                yield id_of(key), np.frombuffer(value, f"<u{self.width}")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all rows with this id (none: an empty list)."""
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bloom_places(doc_id, self.bits)):
            return []
        out, lo, hi = [], key_of(doc_id, 0), key_of(doc_id, 2**32 - 1)
        for block in range(bisect.bisect_left(self.last, lo), len(self.spots)):
            found = [np.frombuffer(v, f"<u{self.width}") for k, v in self.entries(block) if lo <= k <= hi]
            out += found
            if self.last[block] >= hi or not found:
                break
        return out


#: What a tokenizer file must say for its texts to be encoded word by word (format of the tokenizers library).
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}
BPE_BY_WORDS = {"type": "BPE", "dropout": None, "end_of_word_suffix": "</w>", "ignore_merges": False}
#: ASCII characters that are neither blank, letter nor digit; an apostrophe may belong to letters behind it.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Letters of Latin-1 and Latin Extended-A: tried at load, then lower-cased here.
LATIN = [chr(c) for c in (*range(0xC0, 0x180),) if chr(c).isalpha()]


def byte_letters() -> dict[int, str]:
    """The character that the byte-level format writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Encodes texts with the library: word by word if the tokenizer is of the kind that BY_WORDS tells, else whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 65536 else 4
        said = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in said["added_tokens"]]
        self.by_words = all(said.get(k) == v for k, v in BY_WORDS.items()) and all(said["model"].get(k) == v for k, v in BPE_BY_WORDS.items()) and all(t.startswith("<|") and not t.split()[1:] for t in added)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        normal = self.tokenizer.normalizer.normalize_str if self.by_words else str
        safe = "".join(c for c in LATIN if normal(c) == c.lower() and len(c.lower()) == 1)
        self.letters_only = re.compile(f"[a-z{safe}]+")
        self.letter_model = Tokenizer(self.tokenizer.model)  # the same model without the steps that leave such letters as they are
        self.letter_model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.bytes_shown = {b: c for b, c in byte_letters().items() if b != 10}
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def packed(self, ids: list[int] | np.ndarray) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def each(self, words: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        """Words of safe letters alone: encoded many at once, cut behind each token that closes a word."""
        out = []
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            shown = "\n".join(part).lower().encode().decode("latin-1").translate(self.bytes_shown)
            ids = np.array(self.letter_model.encode(shown, add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, at = self.packed(ids), [0, *(ends * self.width).tolist()]
                out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
            else:
                out += self.each(part)
        return out

    def learn(self, fresh: list[bytes]) -> None:
        parts: dict[bytes, tuple[str, str]] = {}
        new: dict[str, bytes] = {}
        for word in fresh:
            text = word.decode()
            core = text.rstrip(MARKS)
            # behind a letter such marks always begin a new token, and they are one
            if core.lower()[-1:].isalpha() and "<|" not in text:
                tail = text[len(core) :]
            else:
                core, tail = text, ""
            parts[word] = core, tail
            new[core] = new[tail] = b""
        safe = self.letters_only.fullmatch
        plain, other = [], []
        for t in new:
            if t:
                (plain if t.isascii() and t.isalpha() and t.islower() or safe(t) else other).append(t)
        new.update(zip(plain, self.letters(plain), strict=True))
        new.update(zip(other, self.each(other), strict=True))
        self.words.update((word, new[core] + new[tail]) for word, (core, tail) in parts.items())

    def encoded(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.by_words:
            yield from self.each([t.decode() for t in texts])
            return
        # a special token's text is the only one whose case matters
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.words) > 2 * CACHE_WORDS:
            self.before, self.words = self.words, {}
        known, before = self.words, self.before
        fresh = [w for w in set().union(*split) if w not in known]
        if before:
            known.update((w, before[w]) for w in fresh if w in before)
            fresh = [w for w in fresh if w not in known]
        self.learn(fresh)
        for words in split:
            yield b"".join(map(self.words.__getitem__, words))


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def file_system(uri: str):
    """(file system, path) for a folder that all executors share."""
    from pyarrow import fs

    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def shards_written(docs: DataFrame, tokenizer: str, end_id: int, folder: str, partitions: int) -> DataFrame:
    """Writes docs(doc_id, text); shard (ascending with the ids), path, n_docs, n_ids. One shard a range of ids.

    A task writes under a name of its own and renames at its end, so a repeated task leaves the same shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = file_system(folder)
        coder = encoder(tokenizer)
        end = coder.packed([end_id])
        temporary = f"{base}/_{task.partitionId():06d}-{task.taskAttemptId()}"
        path = f"{base}/shard-{task.partitionId():06d}.ids"
        writer, before, ordinal = None, None, 0
        for batch in batches:
            ids = iter(batch.column("doc_id").to_pylist())
            for group in in_groups(texts_of(batch)):
                for value in coder.encoded([t or b"" for t in group]):
                    doc_id = next(ids)
                    if writer is None:
                        system.create_dir(base)
                        sink = system.open_output_stream(temporary)
                        writer = ShardWriter(sink, coder.width)
                        ordinal = 0
                    else:
                        ordinal = ordinal + 1 if doc_id == before else 0
                    writer.add(doc_id, ordinal, value + end)
                    before = doc_id
        if writer is not None:
            writer.close()
            sink.close()
            system.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([writer.n], pa.int64()), pa.array([writer.ids], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    ordered = docs.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(run, "shard int, path string, n_docs bigint, n_ids bigint")


def shards_read(shards: DataFrame, folder: str, per_document) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, and per_document(ids) as ids_crc32, from the files alone."""
    begin = shards.withColumn("begin", F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("begin").to_pylist(), strict=True):
                ids, starts, counts, sums = [], [], [], []
                with system.open_input_file(path) as source:
                    for doc_id, tokens in ShardReader(source).all():
                        ids.append(doc_id)
                        starts.append(at)
                        counts.append(len(tokens))
                        sums.append(per_document(tokens))
                        at += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.sparkSession.sparkContext.defaultParallelism)
    spread = begin.select("shard", "path", "begin").repartition(max(n, shards.count()), "shard")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def crc32(tokens: np.ndarray) -> int:
    return zlib.crc32(tokens.astype("<u4").tobytes())


def written(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, shard_docs: int = 8192) -> tuple[DataFrame, str]:
    """(the table of shards, their folder). There is a shard for about ``shard_docs`` documents."""
    spark = docs.sparkSession
    bounded_batches(docs)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = folder or f"{scratch_dir(spark)}/token-ids-{os.urandom(8).hex()}"
    partitions = max(1, -(-docs.select("doc_id").count() // shard_docs))
    return durable(shards_written(docs, tokenizer, end_id, folder, partitions), "token-shards"), folder


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards, folder = written(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return shards_read(shards, folder, crc32)
