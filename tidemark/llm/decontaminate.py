"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are taken in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast is bounded. For a block

1. one pass over the corpus turns each text into the places of the block's words (0 for other words; words
   are lower-cased and stripped of punctuation), counts document frequencies and sketches in how many different
   contexts (pairs of neighbours) a word stands;
2. passages of 32 words are rows of a TF-IDF matrix A over the block's words (words in more than ``max_df`` of
   the documents, and 20 at least, weigh nothing here). Its randomised SVD is distributed: tasks sum up A'(A Omega) and, for its
   orthonormal basis Q, the small (AQ)'(AQ), whose eigenvectors turn Q into right singular vectors;
3. windows of 32 words, 16 apart, and items are projected and each dimension is divided by its singular value, or
   else the language of the words around would drown the item; an item is a candidate where the cosine reaches
   ``cosine`` and enough of its words are there. A word is telling unless both its documents and its contexts are
   many, so an item that stands in many documents keeps its telling words. An item of whose telling words less than
   0.9, or less than four, weigh in A is looked for without vectors: every window with enough of its words is one;
4. a candidate is a leak if the longest common subsequence with the words around has ``ratio`` of the item's
   words, or, for paraphrases, ``loose`` of them while the item's answer (its ``answer`` column, or else its last
   third) is there as well; the same share of the item's telling words must be there in order, for
   paraphrases four of them at least. An item with less than four such words must be there almost wholly (0.95).

Null texts and items count as empty. An item with fewer than ``least_words`` words is no query; one longer than a
block is cut into several with its id. Rows are told apart by id (null is one too) and text: rows that repeat both
give one result, those that repeat an id are judged each. The best of several places in a text is reported. An empty
table on either side gives no leak. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import CACHE_WORDS, MULTIPLIERS, bounded_batches, discard, durable, in_groups, keyed, mixed, summed, texts_of, without

BLOCK_WORDS = 60_000
STEP = 16
PUNCTUATION = b".,;:!?\"'()[]{}<>-*_"
#: Registers of a word's sketch of contexts (HyperLogLog, 13 % of error).
REGISTERS = 64


def normal(word: bytes) -> bytes:
    return word.strip(PUNCTUATION).lower() or word


class Vocabulary(dict):
    """raw word -> place of its normal form in the block, or 0, below 48 bits of its hash; remembered up to a bound."""

    def __init__(self, places: dict[bytes, int]):
        super().__init__()
        self.places = places

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        form = normal(word)
        value = self[word] = (xxhash.xxh3_64_intdigest(form) >> 16 << 16) | self.places.get(form, 0)
        return value


def sketch(registers: np.ndarray, words: np.ndarray) -> None:
    """Adds the contexts of the block's words in words (of a Vocabulary, 0 between texts) to registers."""
    ids = (words & np.uint64(0xFFFF)).astype(np.int64)
    on = np.flatnonzero(ids)
    forms = np.pad(words >> np.uint64(16), 1)
    with np.errstate(over="ignore"):
        context = mixed(forms[on] * MULTIPLIERS[0] + forms[on + 2] * MULTIPLIERS[1])
    rank = 59 - np.frexp((context >> np.uint64(6)).astype(np.float64))[1]
    np.maximum.at(registers.reshape(-1), ids[on] * REGISTERS + (context % np.uint64(REGISTERS)).astype(np.int64), rank.astype(np.uint8))


def contexts(registers: np.ndarray) -> np.ndarray:
    """The estimated number of contexts of each word."""
    raw = 0.709 * REGISTERS**2 / (0.5 ** registers.astype(np.float64)).sum(axis=1)
    empty = (registers == 0).sum(axis=1)
    return np.where((raw <= 2.5 * REGISTERS) & (empty > 0), REGISTERS * np.log(REGISTERS / np.maximum(empty, 1)), raw)


def item_blocks(benchmark: DataFrame, least_words: int, block_words: int = BLOCK_WORDS) -> Iterator[tuple[dict[bytes, int], list[tuple[int, np.ndarray, np.ndarray]]]]:
    """(places of words, [(item_id, places, places of the answer)]) for blocks of at most ``block_words`` words.

    A longer item becomes several queries with its id; all of about the same length.
    """
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    places: dict[bytes, int] = {}
    items: list = []
    total = 0
    for row in benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).orderBy("item_id", "text").toLocalIterator():
        whole = [normal(w) for w in (row.text or "").encode().split()]
        if len(whole) < least_words:
            continue
        parts = -(-len(whole) // block_words)
        cuts = [len(whole) * k // parts for k in range(parts + 1)]
        for words in (whole[i:j] for i, j in zip(cuts, cuts[1:], strict=False)):
            if total + len(words) > block_words and items:
                yield places, items
                places, items, total = {}, [], 0
            total += len(words)
            at = np.array([places.setdefault(w, len(places) + 1) for w in words], np.uint16)
            said = [places[w] for w in map(normal, (row.answer or "").encode().split()) if w in places]
            items.append((row.item_id, at, np.array(said, np.uint16) if said else at[-max(3, len(at) // 3) :]))
    if items:
        yield places, items


def placed(docs: DataFrame, places) -> DataFrame:
    """doc_id, row_key, ids (places, 16 bits each), and a row (task, counts, registers) with a task's document frequencies and sketches."""
    names = ["doc_id", "row_key", "ids", "task", "counts", "registers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Vocabulary(places.value).__getitem__
        df = np.zeros(len(places.value) + 1, np.int64)
        registers = np.zeros((len(places.value) + 1, REGISTERS), np.uint8)
        between = np.zeros(1, np.uint64)
        for batch in batches:
            out = []
            for group in in_groups(texts_of(batch)):
                found = []
                for text in group:
                    words = (text or b"").split()
                    found += [np.fromiter(map(lookup, words), np.uint64, len(words)), between]
                    ids = (found[-2] & np.uint64(0xFFFF)).astype(np.uint16)
                    df[np.unique(ids)] += 1
                    out.append(ids.tobytes())
                sketch(registers, np.concatenate(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(out, pa.binary()), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary()), pa.nulls(len(out), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([df.tobytes()], pa.binary()), pa.array([registers.tobytes()], pa.binary())], names)

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id bigint, row_key bigint, ids binary, task int, counts binary, registers binary")


class Stretch:
    """Some documents' places in one array, cut into steps of STEP words."""

    def __init__(self, raw: list[bytes]):
        lens = np.array([len(r) // 2 for r in raw], np.int64)
        self.ids = np.frombuffer(b"".join(raw), np.uint16)
        steps = -(-lens // STEP)
        self.first_step = np.cumsum(steps) - steps  # of each document
        self.first_word = np.cumsum(lens) - lens
        self.lens, self.steps = lens, steps
        self.doc = np.repeat(np.arange(len(raw)), steps)  # of each step
        of = np.repeat(np.arange(len(raw)), lens)
        self.step = self.first_step[of] + (np.arange(len(self.ids)) - self.first_word[of]) // STEP  # of each word

    def sums(self, ids: np.ndarray, step: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Sums of the words' vectors for each step."""
        out = np.zeros((int(self.steps.sum()), vectors.shape[1]), vectors.dtype)
        if len(ids):
            starts = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
            out[step[starts]] = np.add.reduceat(vectors[ids], starts, axis=0)
        return out


def stretches(batch: pa.RecordBatch, most_words: int = 100_000) -> Iterator[tuple[slice, Stretch]]:
    raw = batch.column("ids").to_pylist()
    at = size = 0
    for i, r in enumerate(raw):
        if size and size + len(r) // 2 > most_words:
            yield slice(at, i), Stretch(raw[at:i])
            at, size = i, 0
        size += len(r) // 2
    if raw:
        yield slice(at, len(raw)), Stretch(raw[at:])


#: Bytes of an array that are summed together: many tasks share in the sum of a large one.
SUM_BYTES = 1 << 20


def in_blocks(array: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's array as rows (task, block, counts)."""
    raw, task = array.tobytes(), TaskContext.get().partitionId()
    for block, at in enumerate(range(0, len(raw), SUM_BYTES)):
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([block], pa.int32()), pa.array([raw[at : at + SUM_BYTES]], pa.binary())], ["task", "block", "counts"])


def total_of(rows: DataFrame, tasks: int, kind: type, shape: tuple, add: np.ufunc = np.add) -> np.ndarray:
    """The sum of the tasks' arrays (task, block, counts), whose size is bounded by the block's words."""
    found = sorted((r.block, bytes(r.counts)) for r in summed(rows.select("task", "block", "counts"), tasks, kind, add).toLocalIterator())
    return np.frombuffer(b"".join(x for _, x in found), kind).reshape(shape) if found else np.zeros(shape, kind)


def over_passages(texts: DataFrame, idf, vectors, gram: bool, tasks: int) -> np.ndarray:
    """A'(AX) for X = vectors, or (AX)'(AX) with ``gram``; A has a row for each passage of 2 * STEP words."""
    words, width = vectors.value.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, x = idf.value, vectors.value
        scaled = (weight[:, None] * x).astype(np.float32)
        keep = weight > 0
        out = np.zeros((width, width) if gram else (words, width), np.float64)
        for batch in batches:
            for _, s in stretches(batch):
                on = keep[s.ids]
                ids = s.ids[on]
                # passages are pairs of steps, each within one document
                inside = s.step[on] - s.first_step[s.doc[s.step[on]]]
                passage = s.step[on] - inside % 2
                sums = s.sums(ids, passage, scaled)
                if gram:
                    out += sums.T.astype(np.float64) @ sums
                elif len(ids):
                    rows = sums[passage]
                    for c in range(width):
                        out[:, c] += np.bincount(ids, weights=rows[:, c], minlength=words)
        yield from in_blocks(out if gram else weight[:, None] * out)

    return total_of(texts.select("ids").mapInArrow(run, "task int, block int, counts binary"), tasks, np.float64, (width, width) if gram else (words, width))


def common_subsequence(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (masks: word -> its places as bits) and words."""
    full = (1 << length) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def masks_of(ids: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(ids.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def searched(texts: DataFrame, items, projection, telling, cosine: float, ratio: float, loose: float, answer: float) -> DataFrame:
    """doc_id, row_key, item_id, lcs, ratio, cosine: the leaks."""
    names = ["doc_id", "row_key", "item_id", "lcs", "ratio", "cosine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vectors = items.value, projection.value
        keep, tells = np.abs(vectors).max(axis=1) > 0, telling.value
        queries = np.stack([vectors[at].sum(axis=0) for _, at, _ in known])
        queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
        member = np.zeros((len(known), len(vectors)), np.float32)
        poor = [int(tells[at].sum()) < 4 for _, at, _ in known]
        for i, (_, at, _) in enumerate(known):
            member[i, at if poor[i] else at[tells[at]]] = 1
        distinct = np.maximum(member.sum(axis=1), 1)
        direct = np.flatnonzero([keep[at].sum() < max(4, 0.9 * tells[at].sum()) for _, at, _ in known])
        chunks = [(few, np.ascontiguousarray(member[few].T), member[few].any(axis=0)) for few in np.split(direct, range(64, len(direct), 64)) if len(few)]
        masks = [(masks_of(at), len(at), masks_of(said), len(said), masks_of(at[tells[at]]), int(tells[at].sum())) for _, at, said in known]
        for batch in batches:
            doc_ids, keys = batch.column("doc_id"), batch.column("row_key")
            out: list[tuple] = []
            for part, s in stretches(batch):
                if not len(s.ids):
                    continue
                on = keep[s.ids]
                sums = s.sums(s.ids[on], s.step[on], vectors)
                nxt = np.append(s.doc[1:] == s.doc[:-1], False)
                wins = sums.copy()
                wins[nxt] += sums[1:][nxt[:-1]]
                norms = np.linalg.norm(wins, axis=1, keepdims=True)
                cos = (wins / np.maximum(norms, 1e-9)) @ queries.T
                best: dict[tuple[int, int], tuple] = {}
                done: dict[tuple[int, int], int] = {}
                # the words of each window, and how many of them (repeats included) weigh something in the item
                words_of = np.zeros((len(s.doc) + 1, STEP), np.uint16)
                words_of[s.step, (np.arange(len(s.ids)) - s.first_word[s.doc[s.step]]) % STEP] = s.ids
                candidate = cos >= cosine
                for few, members, used in chunks:
                    on = used[s.ids]
                    hits = s.sums(s.ids[on], s.step[on], members)
                    wins = hits.copy()
                    wins[nxt] += hits[1:][nxt[:-1]]
                    candidate[:, few] |= wins >= 0.35 * np.minimum(distinct[few], 2 * STEP)
                    for i in few.tolist():
                        if poor[i]:  # 0.95 of its words must be around, in any order
                            n = masks[i][1]
                            first, at = s.first_word[s.doc], s.first_word[s.doc] + (np.arange(len(s.doc)) - s.first_step[s.doc]) * STEP
                            lo, hi = np.maximum(first, at - n), np.minimum(first + s.lens[s.doc], at + 2 * STEP + n)
                            upto = np.append(0, np.cumsum(member[i, s.ids], dtype=np.int64))
                            candidate[:, i] &= upto[hi] - upto[lo] >= 0.95 * n
                win, item = np.nonzero(candidate)
                found = member[item[:, None], words_of[win]].sum(axis=1) + np.where(nxt[win], member[item[:, None], words_of[win + 1]].sum(axis=1), 0)
                on = found >= 0.35 * np.minimum(distinct[item], 2 * STEP)
                for w, i in zip(win[on].tolist(), item[on].tolist(), strict=True):
                    d = int(s.doc[w])
                    first = int(s.first_word[d])
                    at = first + (w - int(s.first_step[d])) * STEP
                    here = s.ids[at : min(at + 2 * STEP, first + int(s.lens[d]))]
                    m_item, n_item, m_said, n_said, m_rare, n_rare = masks[i]
                    if member[i, np.unique(here)].sum() < 0.35 * min(distinct[i], 2 * STEP):
                        continue
                    if done.get((d, i), -1) >= at:  # that window lay in words compared already
                        continue
                    lo, hi = max(first, at - n_item), min(first + int(s.lens[d]), at + 2 * STEP + n_item)
                    done[d, i] = hi - 2 * STEP - n_item // 2
                    words = s.ids[lo:hi].tolist()
                    lcs = common_subsequence(m_item, n_item, words)
                    if lcs < loose * n_item:
                        continue
                    rare = common_subsequence(m_rare, n_rare, words)
                    least = ratio if n_rare >= 4 else 0.95
                    if lcs >= least * n_item and rare >= least * n_rare or rare >= max(4, loose * n_rare) and common_subsequence(m_said, n_said, words) >= answer * n_said:
                        best[d, i] = max(best.get((d, i), (0, 0.0)), (lcs, float(cos[w, i])))
                for (d, i), (lcs, c) in best.items():
                    out.append((doc_ids[part.start + d], keys[part.start + d], known[i][0], lcs, lcs / masks[i][1], c))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in c] if k < 2 else c, t) for k, (c, t) in enumerate(zip(columns, kinds, strict=True))], names)

    return texts.select("doc_id", "row_key", "ids").mapInArrow(run, "doc_id bigint, row_key bigint, item_id bigint, lcs bigint, ratio double, cosine double")


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 80, extra: int = 16, cosine: float = 0.25, ratio: float = 0.75, loose: float = 0.5, answer: float = 0.8, max_df: float = 0.03, least_words: int = 8, seed: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, row_key (xxhash64 of the text), item_id, lcs, ratio, cosine: a row for each pair of a text and an item in it."""
    spark = docs.sparkSession
    bounded_batches(docs)
    send = spark.sparkContext.broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    out = None
    for places, items in item_blocks(benchmark, least_words, block_words):
        rows = durable(placed(docs, send(places)), "leak-places")
        texts, counts = rows.where("ids is not null"), rows.where("counts is not null")
        tasks = counts.agg(F.coalesce(F.max("task"), F.lit(0)) + 1).first()[0]
        df = total_of(counts.withColumn("block", F.lit(0)), tasks, np.int64, (len(places) + 1,))
        n_docs = max(int(texts.count()), 1)
        idf = np.log((1 + n_docs) / (1 + df))
        most = max(max_df * n_docs, 20)
        idf[df > most] = 0
        telling = (df <= most) | (contexts(total_of(counts.select("task", F.lit(0).alias("block"), F.col("registers").alias("counts")), tasks, np.uint8, (len(places) + 1, REGISTERS), np.maximum)) <= most)
        telling[0] = False
        idf[0] = 0
        width = min(rank + extra, len(places))
        start = np.random.default_rng(seed).standard_normal((len(places) + 1, width))
        weights = send(idf)
        basis, _ = np.linalg.qr(over_passages(texts, weights, send(start), False, tasks))
        values, turn = np.linalg.eigh(over_passages(texts, weights, send(basis), True, tasks))
        top = np.argsort(-values)[:rank]
        scale = 1 / np.sqrt(np.maximum(values[top], max(values.max(), 1e-9) * 1e-9))  # of eigenvalues, squares of singular values
        projection = (idf[:, None] * (basis @ turn[:, top]) * scale).astype(np.float32)
        found = durable(searched(texts, send(items), send(projection), send(telling), cosine, ratio, loose, answer), "leak-found")
        discard(rows)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, row_key bigint, item_id bigint, lcs bigint, ratio double, cosine double")
    return out.groupBy("doc_id", "row_key", "item_id").agg(F.max("lcs").alias("lcs"), F.max("ratio").alias("ratio"), F.max("cosine").alias("cosine"))


def cleaned(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows that leak an item; rows are told apart by id and text, all columns stay, whatever their names."""
    found = durable(leaks(docs, items, **options).select("doc_id", "row_key").distinct(), "leak-rows")
    return without(keyed(docs), found).select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "lcs", F.round("ratio", 4).alias("ratio"))
