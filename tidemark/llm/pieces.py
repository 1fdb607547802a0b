"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The text's blanks become U+2581 and it is cut where a blank run begins and around line feeds; the model is
checked at load time to have no piece that crosses such a cut. The distinct words of a batch lie in one flat numpy
array of symbols. In a round each word's best pair rank is a segmented minimum, its leftmost non-overlapping
occurrences merge at once, and the array is compacted; words without a pair leave. Where a merge gives a new
pair that is as good as the merged one or better, one merge at a time is due: such words (runs of
blanks, whose pieces all tie) go to an agenda. What is left becomes piece ids, or UTF-8 bytes
where the vocabulary has no piece. Null texts count as empty. No word or text is cut short. Pieces of equal rank merge from
the left. Other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import CACHE_WORDS, bounded_batches, in_groups, texts_of

BLANK = "▁"
NONE = np.int64(2**62)
WORDS = re.compile(r" *[^ \n]+| +|\n")


class Pieces:
    """A SentencePiece BPE model with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        spec.ParseFromString(processor.serialized_model_proto())
        norm, trainer = spec.normalizer_spec, spec.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("an identity normaliser is needed")
        self.prefix = " " if norm.add_dummy_prefix else ""  # before every text but the empty one
        self.end = processor.eos_id()
        self.names = [p.piece for p in spec.pieces]
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        if any(p.type == 4 for p in spec.pieces) or any(re.search(f"[^{BLANK}]{BLANK}|.\n|\n.", p, re.S) for p in normal):
            raise ValueError("a piece crosses the cuts between words")
        self.byte_ids = [0] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        self.raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(BLANK, " ").encode() for p in spec.pieces]
        # symbols: pieces, then characters that only occur inside pieces, then any other character by code point
        symbols = dict(normal)
        for piece in normal:
            for c in piece:
                symbols.setdefault(c, len(spec.pieces) + len(symbols))
        self.others = 4 * (len(spec.pieces) + len(symbols))
        self.text_of = {i: s for s, i in symbols.items()}
        single = sorted((ord(s), i) for s, i in symbols.items() if len(s) == 1)
        self.chars = np.array([c for c, _ in single], np.int64)
        self.char_ids = np.array([i for _, i in single], np.int64)
        scores = np.array([spec.pieces[i].score for i in normal.values()])
        ranks = dict(zip(normal.values(), np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        pairs = sorted((symbols[p[:k]] << 32 | symbols[p[k:]], ranks[i], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.keys = np.array([k for k, _, _ in pairs], np.int64)
        self.ranks = np.array([r for _, r, _ in pairs], np.int64)
        self.results = np.array([i for _, _, i in pairs], np.int64)
        self.pair = {k: (r, i) for k, r, i in pairs}
        self.decimal = [str(i).encode() for i in range(len(spec.pieces))]
        self.cache: dict[str, tuple[bytes, int, bytes]] = {}

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair is no piece) and merged symbol of each pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.results[at]

    def agenda(self, symbols: list[int]) -> list[int]:
        """One merge at a time, the best rank first, the leftmost at a tie."""
        n = len(symbols)
        before, behind = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.pair.get(symbols[i] << 32 | symbols[j])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = behind[i] if symbols[i] == a else -1
            if j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = merged, -1
            behind[i] = behind[j]
            if behind[j] >= 0:
                before[behind[j]] = i
            offer(before[i], i)
            offer(i, behind[i])
        return [s for s in symbols if s >= 0]

    def merged(self, words: list[str]) -> list[list[int]]:
        """The final symbols of each (non-empty) word."""
        if not words:
            return []
        left_sym, left_word, by_agenda = [], [], {}
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        sym = np.where(self.chars[at] == points, self.char_ids[at], self.others + points)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lens)
        rank, result = self.looked_up(sym, np.append(sym[1:], 0))
        rank[np.append(word[1:] != word[:-1], True)] = NONE
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            alive = best < NONE
            still = np.repeat(alive, size)
            left_sym.append(sym[~still])
            left_word.append(word[~still])
            best_here = np.repeat(best, size)
            wanted = (rank == best_here) & still
            # of a run of overlapping candidates every other one, from the left
            index = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(wanted, -1, index))
            take = wanted & ((index - run) % 2 == 1)
            keep = ~np.append(False, take[:-1]) & still
            fresh = take[keep]
            sym2, word2, rank2, result2 = np.where(take, result, sym)[keep], word[keep], rank[keep], result[keep]
            # only pairs with a merged symbol are new
            touched = np.flatnonzero(fresh | np.append(fresh[1:], False))
            rank2[touched], result2[touched] = self.looked_up(sym2[touched], np.append(sym2[1:], 0)[touched])
            rank2[np.append(word2[1:] != word2[:-1], True)[: len(word2)]] = NONE
            early = touched[rank2[touched] <= best_here[keep][touched]]
            if len(early):
                late = np.unique(word2[early])
                for w in late.tolist():
                    lo, hi = np.searchsorted(word, [w, w + 1])
                    by_agenda[w] = self.agenda(sym[lo:hi].tolist())
                stay = ~np.isin(word2, late)
                sym2, word2, rank2, result2 = sym2[stay], word2[stay], rank2[stay], result2[stay]
            sym, word, rank, result = sym2, word2, rank2, result2
        all_sym, all_word = np.concatenate(left_sym), np.concatenate(left_word)
        all_sym = all_sym[np.argsort(all_word, kind="stable")].tolist()
        cuts = np.append(0, np.cumsum(np.bincount(all_word, minlength=len(words)))).tolist()
        return [by_agenda[i] if a == b else all_sym[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def ids(self, symbols: list[int]) -> list[int]:
        if max(symbols) < len(self.names):
            return symbols
        out: list[int] = []
        for s in symbols:
            if s < len(self.names):
                out.append(s)
            else:
                c = chr(s - self.others) if s >= self.others else self.text_of[s]
                out.extend(self.byte_ids[b] for b in c.encode())
        return out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text: byte pieces as their bytes (U+FFFD for what is no UTF-8), control pieces as nothing."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").encode()

    def encoded(self, texts: list[str]) -> Iterator[list[tuple[bytes, int, bytes]]]:
        """For each text its words' (decimal ids joined by blanks, number of ids, decoded text), in order."""
        split = [WORDS.findall(self.prefix + t.replace(BLANK, " ")) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        fresh = list({w for words in split for w in words} - self.cache.keys())
        for word, symbols in zip(fresh, self.merged([w.replace(" ", BLANK) for w in fresh]), strict=True):
            ids = self.ids(symbols)
            text = b"".join(map(self.raw.__getitem__, ids)) if ids is symbols else self.decode(ids)
            self.cache[word] = (b" ".join(map(self.decimal.__getitem__, ids)), len(ids), text)
        for words in split:
            yield [self.cache[w] for w in words]


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, path: str, digests: bool = False, decoded: bool = True) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_tokens and (ids, decoded text unless it is not wanted), or their SHA-256 digests.

    Ids have an end id. Each row is judged for itself, so repeated ids and rows stay; an empty table gives an empty one.
    """
    bounded_batches(docs)
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")[: 1 + decoded])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            counts, first, second = [], [], []
            groups = in_groups(texts_of(batch))
            for parts in (x for g in groups for x in model.encoded([(t or b"").decode() for t in g])):
                ids = b" ".join([p[0] for p in parts] + [str(model.end).encode()])
                text = b"".join([p[2] for p in parts])[len(model.prefix) :] if decoded else b""
                counts.append(sum([p[1] for p in parts]) + 1)
                if digests:
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(text).hexdigest())
                else:
                    first.append(np.array(ids.split(), np.int32))
                    second.append(text.decode())
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())][: len(names)], names)

    schema = "doc_id bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>" + ", decoded string" * decoded)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path(), digests=True)
