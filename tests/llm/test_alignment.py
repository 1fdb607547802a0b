"""Alignment of two tokenizers against a plain double loop over token ranges."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment

DATA = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string"


def brute(rows):
    """One row a document, by comparing each token of one side with those of the other that it overlaps."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    chars = alignment.byte_of_char()
    linked, out = defaultdict(set), []
    for k, (doc_id, text) in enumerate(rows):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == b" " + text.encode():
            out.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        links, groups, group, i, j, end_a, end_b = Counter(), [], ([], []), 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if end_a <= end_b and i < len(ids_a):
                end_a += len(raw_a[i])
                group[0].append(ids_a[i])
                i += 1
            else:
                end_b += len(raw_b[j])
                group[1].append(ids_b[j])
                j += 1
            if group[0] and group[1] and min(end_a, end_b) > max(end_a - len(raw_a[i - 1]), end_b - len(raw_b[j - 1])):
                links[ids_a[i - 1], ids_b[j - 1]] += 1
            if end_a == end_b:
                groups.append(group)
                group = ([], [])
        for pair in links:
            linked[pair].add(k)
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest()))
    most = defaultdict(int)
    for (x, _), docs in linked.items():
        most[x] = max(most[x], len(docs))
    rows = [
        (doc_id, na, nb, ng, sum(links.values()), sum(n for p, n in links.items() if len(linked[p]) == most[p[0]]), sum(n * len(linked[p]) for p, n in links.items()), sha)
        for doc_id, na, nb, ng, links, sha in out
    ]
    return rows, {p: (len(d), len(d) == most[p[0]]) for p, d in linked.items()}


def hard_rows():
    rng = random.Random(2)
    some = ["the", "The", "über", "naïve", "漢字仮名", "🙂", "👩‍👩‍👧", "x" * 70, "3.1415", "it's", "<|endoftext|>", "</s>", "<0x41>", "…", " ", "a\tb", "\x1f", "ё", "é", "﻿", "ⅷ", "𐐷"]
    rows = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "\n\n a  b   \t c"), (6, "▁"), (None, "no id"), (7, "same"), (7, "same"), (7, "other"), (8, "word " * 30_000), (9, "z" * 5_000), (10, " lead and trail  ")]
    return rows + [(100 + i, rng.choice(["", " "]).join(rng.choice(some) for _ in range(rng.randint(1, 60)))) for i in range(80)] + [(300 + i, "ok") for i in range(60)]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"run_records": 200, "part_bytes": 500}], ids=["one run", "many runs and parts"])
def test_hard_rows(spark, options):
    """Nulls, repeats, a third of the rows alike, long texts, bytes that a side does not give back; other columns do not matter."""
    rows = hard_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(k).alias(c) for k, c in enumerate(("run", "radix", "place", "pairs", "groups", "n_a"))])
    got = alignment.aligned(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), digests=True, **options)
    assert result(got) == sorted(brute(rows)[0], key=str)


def test_pair_counts_and_groups(spark):
    rows = hard_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    assert {(r.a, r.b): (r.documents, r.best) for r in alignment.pair_counts(docs, *paths, run_records=1000).collect()} == brute(rows)[1]
    shown = {r.doc_id: r.groups for r in alignment.aligned(docs, *paths).where("doc_id in (1, 10)").collect()}
    assert shown[1] == "" and shown[10].count("|") == shown[10].count(";") + 1
    assert alignment.aligned(docs.limit(0), *paths).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = alignment.op11_alignment(spark, DATA)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert result(got) == sorted(brute(rows)[0], key=str)
