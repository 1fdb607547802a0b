"""Stages and operators on hard rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns; whole results against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, decontaminate, language, ngram_join, pii, quality, sstable, substrings, url_filters
from tidemark.llm.shared import bit_table, components, durable

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHES = ("row", "row_key", "spans", "groups", "pieces", "cls", "n", "component", "sigs", "kept", "_row", "base_failed", "some_id", "some_key", "stratum", "own", "cuts", "_pii_id", "_leak_key", "a.b", "first")


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def stage_docs(spark):
    rng = random.Random(3)
    text = prose(rng, 60)
    rows = [(1, text), (2, text), (3, text + " more"), (3, prose(rng, 50)), (4, None), (5, ""), (5, ""), (6, prose(rng, 60_000)), (None, prose(rng, 40)), (None, text), (7, prose(rng, 30) + " call a.b@example.org now"), (7, prose(rng, 30) + " again 10.1.2.3"), (8, "short"), (9, "x y " * 50)]
    rows += [(9, "x y " * 50)]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or "")) for i, t in rows], SCHEMA)


def with_clashes(docs):
    return docs.select("*", *[F.lit(k).alias(name) for k, name in enumerate(CLASHES)])


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    plain = stage_docs(spark)
    docs = with_clashes(plain)
    out = run(spark, docs, DATA)
    if stage != "sentence_pieces":
        assert out.columns == docs.columns
        got = out.collect()
        assert all(tuple(r)[5:] == tuple(range(len(CLASHES))) for r in got)
        one = sorted(((r.doc_id, r.text) for r in run(spark, plain, DATA).collect()), key=str)
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == one
    assert run(spark, docs.limit(0), DATA).count() == 0


def shingles(text, n):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_near_duplicates_keep_one(spark):
    """One row of each group of near copies, the least id; rows that repeat an id with other texts are judged each."""
    docs = stage_docs(spark)
    rows = sorted({(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}, key=str)
    sets = [shingles(t, 5) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(d for (d, _), h in zip(rows, group, strict=True) if h == g) for g in group}
    got = corpus_pipeline.near_duplicates(spark, docs, DATA).collect()
    kept = Counter((r.doc_id, r.text) for r in got if r.doc_id is not None)
    assert set(kept.values()) == {1} and sum(r.doc_id is None for r in got) == 2
    assert sorted(Counter(group[rows.index(k)] for k in kept).values()) == [1] * len(set(group))
    assert all(k[0] == least[group[rows.index(k)]] for k in kept)


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages over a small corpus with planted cases."""
    import public_tokenizers
    import sentencepiece

    rng = random.Random(11)
    items = [(k, prose(rng, 30)) for k in range(3)]
    rows = {i: prose(rng, 40 + i) for i in range(40)}
    rows[50] = rows[7] + " tail"  # a near copy of 7
    rows[51] = prose(rng, 30) + " " + items[1][1] + " " + prose(rng, 30)  # a leak
    rows[52] = "write to jo.doe@example.org or 10.20.30.40 " + prose(rng, 30)
    rows[53], rows[54], rows[55] = "too short", None, "again and again we say the same eight words " * 20
    for name, schema, data in (("documents", SCHEMA, [(i, t, "en", "s", len(t or "")) for i, t in rows.items()]), ("benchmark", "item_id bigint, text string", items), ("labels", "doc_id bigint, quality bigint, toxic bigint", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: t for i, t in rows.items() if i not in (50, 51, 53, 54, 55)}
    want[52] = want[52].replace("jo.doe@example.org", "[email]").replace("10.20.30.40", "[ip]")
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: model.encode(t) + [model.eos_id()] for i, t in want.items()}


def test_components_of_long_chains(spark):
    """A path of 5,000 nodes in random order takes more rounds than any fixed few."""
    nodes = list(range(5000))
    random.Random(4).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a bigint, b bigint")
    assert {tuple(r) for r in components(edges).agg(F.count("*"), F.min("component"), F.max("component")).collect()} == {(5000, 0, 0)}
    assert components(edges.limit(0)).count() == 0


def test_bit_tables_lose_nothing(spark):
    ids = durable(spark.range(0, 200_000, 7).select((F.col("id") * 1_000_003 - 5).alias("id")), "ids")
    table = bit_table(ids)
    here = np.arange(0, 200_000, 7) * 1_000_003 - 5
    assert table.has(here).all() and table.has(here + 1).mean() < 0.1


def test_signatures_of_all_sizes(spark):
    """Sets that just reach the threshold share a signature, whatever their sizes; so do the sparse ones."""
    rng = np.random.default_rng(8)
    for percent in (80, 90):
        signatures = ngram_join.Signatures(percent)
        for size in (*range(4, 40), 75, 150, 800, 3000):
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**64, size, np.uint64))
                more = int(rng.integers(0, len(a) * (100 - percent) // percent + 1))
                gone = max((g for g in range(len(a)) if 100 * (len(a) - g) >= percent * (len(a) + more)), default=0)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 2**64, more, np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    assert len(np.intersect1d(signatures.of(a), signatures.of(b))), (percent, size, gone, more)


def test_secrets_and_whole_phones(spark):
    """Values assigned to secret names, behind other names once patterns are learned, and phone numbers that run into an address."""
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'{prose(rng, 8)} token = "{key()}" {prose(rng, 8)}') for i in range(40)] + [(100, f'{prose(rng, 8)} clef = "{key()}" {prose(rng, 8)}'), (101, f"{prose(rng, 8)} {key()[:9]} {prose(rng, 4)}")]
    rows += [(200 + i, f"{prose(rng, 5)} +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {prose(rng, 5)}") for i in range(40)] + [(300, "at +1 (843) 555-7672 170.106.47.218 end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [(s.kind, s.match) for s in r.spans] for r in pii.detected(docs).collect()}
    assert all(got[i] == [("secret", rows[i][1].split('"')[1])] for i in range(40))
    assert got[100] == [("secret", rows[40][1].split('"')[1])] and got[101] == []
    assert got[300] == [("phone", "+1 (843) 555-7672"), ("ip", "170.106.47.218")]
    assert {r.doc_id: r.text for r in pii.masked(docs).collect()}[300] == "at [phone] [ip] end"


def test_secrets_of_the_tables(spark):
    """Recall on the given documents: every quoted token of 16 digits and letters or more, whole, and nothing in documents without any candidate."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {(r.doc_id, m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer(r'(?i)token = "([0-9a-f]{16,})"', r.text or "")}
    got = {(r.doc_id, s.start, s.stop) for r in pii.detected(docs).collect() for s in r.spans if s.kind == "secret"}
    assert want and got == want


def test_pii_of_very_long_texts(spark):
    """Twenty thousand numbers in one text: positions as of a plain search."""
    text = " ".join(f"{i % 256}.1.2.3 é" for i in range(20_000))
    got = pii.detected(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    want = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+\.1\.2\.3", text)]
    assert [(s.start, s.stop) for s in got.base] == want


def test_long_items_and_hot_items(spark):
    """An item longer than a block is looked for in parts, not skipped; repeats and ties give one result a row and item."""
    rng = random.Random(9)
    long = prose(rng, 400)
    docs = spark.createDataFrame([(1, prose(rng, 50) + " " + long + " " + prose(rng, 50)), (2, prose(rng, 900)), (1, prose(rng, 50)), (None, long), (3, None), (4, ""), (5, prose(rng, 40_000) + " " + long)] * 2, "doc_id bigint, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(1, long), (2, prose(rng, 12)), (3, None), (4, "few words")], "item_id bigint, text string"), block_words=100).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == [(1, 1), (5, 1), (None, 1)]


def test_leaks_of_the_tables(spark):
    """Pairs whose text holds over half of an item's five-word sequences, and no others, on the given documents."""
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    grams = {r.item_id: shingles(r.text, 5) for r in items.collect()}
    of = defaultdict(set)
    for i, g in grams.items():
        for x in g:
            of[x].add(i)
    want = set()
    for r in docs.collect():
        hits = Counter(i for x in shingles(r.text, 5) for i in of.get(x, ()))
        want |= {(r.doc_id, i) for i, n in hits.items() if 2 * n > len(grams[i])}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert want and got == want


def test_language_evidence_decides(spark):
    """Fused posteriors against a plain computation, on pages whose markup, suffix or host must decide, and on ties and repeats."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    base = spark.read.parquet(f"{DATA}/pages.parquet").where("page_id < 400")
    texts = {r.lang: r.text for r in docs.where("n_chars > 300").orderBy("doc_id").collect()}
    told = [(20_000 + 100 * k + j, f"http://h{j % 3}.site.{lang}x/p", f'<html lang="{lang}"><p>{texts[lang][:300]}</p>') for k, lang in enumerate(sorted(texts)) for j in range(12)]
    bare = [(30_000 + 3 * k + j, [None, f"http://new.other.{lang}x/", f"http://h1.site.{lang}x/q"][j], [f'<html lang="{lang}"><p>12 34</p>', "<p>...</p>", ""][j]) for k, lang in enumerate(sorted(texts)) for j in range(3)]
    odd = [(40_000, None, None), (40_001, None, "x" * 200_000), (40_001, None, "x" * 200_000)]
    pages = base.union(spark.createDataFrame(told + bare + odd, base.schema))
    languages, tables = language.trained(docs, 20_000)
    table = np.concatenate(tables)
    host, _ = url_filters.host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,8})""", 1)).alias("declared"), language.visible(F.coalesce("html", F.lit(""))).alias("text")).collect()
    seen = []
    for r in rows:
        t = language.trigrams((r.text or "").encode())
        scores = table[:, t].mean(axis=1).astype(float) if len(t) else np.zeros(len(languages))
        suffix = re.search(r"\.([^.]+)\Z", r.host)
        domain = re.search(r"([^.]+\.[^.]+)\Z", r.host)
        seen.append({"id": r.page_id, "scores": scores, "n": len(t), "by": int(scores.argmax()), "declared": r.declared, "suffix": suffix[1] if suffix else "", "domain": domain[1] if domain else "", "host": r.host})
    k = len(languages)
    whole = np.array([sum(x["by"] == i and x["n"] > 0 for x in seen) for i in range(k)]) + 1.0
    votes = {f: defaultdict(lambda: np.zeros(k)) for f in ("declared", "suffix", "domain", "host")}
    for x in seen:
        for f in votes:
            if x["n"]:
                votes[f][x[f]][x["by"]] += 1
    kinds = {f: len({x[f] for x in seen if x[f]}) for f in ("declared", "suffix")}
    totals = {f: sum((v for name, v in votes[f].items() if name), np.zeros(k)) for f in kinds}
    want = {}
    for x in seen:
        mine = np.array([float(i == x["by"] and x["n"] > 0) for i in range(k)])
        at = whole
        for f in ("domain", "host"):
            if x[f]:
                at = votes[f][x[f]] - mine + 5.0 * at / at.sum()
        p = np.log(at / at.sum()) + x["scores"] * min(x["n"], 40.0)
        for f in kinds:
            if x[f]:
                p = p + np.log((votes[f][x[f]] - mine + 1.0) / (totals[f] + kinds[f] + 1.0))
        want.setdefault(x["id"], []).append((languages[int(p.argmax())], 1 / np.exp(p - p.max()).sum()))
    got = defaultdict(list)
    for r in language.identified(pages, docs).collect():
        got[r.page_id].append((r.lang, r.confidence))
    assert got.keys() == want.keys()
    for page, pairs in want.items():
        assert [x for x, _ in got[page]] == [x for x, _ in pairs]
        assert all(math.isclose(a, b, abs_tol=2e-5) for (_, a), (_, b) in zip(got[page], pairs, strict=True))
    for j, (page, _, _) in enumerate(bare):  # without text the other evidence decides
        assert want[page][0][0] == sorted(texts)[j // 3]


def test_a_language_of_three_words_takes_no_strange_pages(spark):
    """Text unlike all training text goes to no tiny language, whose own words are still known; rare languages are sampled."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text")
    docs = docs.union(spark.createDataFrame([(10**9, "zz", "quolvex brimtaz yondrel")], docs.schema))
    strange = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Все люди рождаются свободными и равными в своем достоинстве и правах", "すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である"]
    texts = [*strange, "brimtaz quolvex yondrel quolvex yondrel brimtaz"]
    pages = spark.createDataFrame([(i, f"http://h{i}.example/", f"<html><body>{t}</body></html>") for i, t in enumerate(texts)], "page_id bigint, url string, html string")
    got = {r.page_id: r.lang for r in language.identified(pages, docs, train_docs=400).collect()}
    assert "zz" not in [got[i] for i in range(len(strange))] and got[len(strange)] == "zz"


def test_many_languages(spark):
    """More labels than one block of tables holds."""
    rng = random.Random(2)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    words = {f"l{k:03}": [a + b for a, b in zip(alphabet[3 * k : 3 * k + 3], alphabet[3 * k + 1 : 3 * k + 4], strict=False)] for k in range(70)}
    docs = spark.createDataFrame([(k * 10 + j, " ".join(rng.choices(w, k=30)), lang) for k, (lang, w) in enumerate(words.items()) for j in range(3)], "doc_id bigint, text string, lang string")
    pages = spark.createDataFrame([(k, None, " ".join(rng.choices(w, k=40))) for k, w in enumerate(words.values())], "page_id bigint, url string, html string")
    got = {r.page_id: r.lang for r in language.identified(pages, docs).collect()}
    assert got == dict(enumerate(words))


def test_url_verdicts_against_brute_force(spark):
    """Edges, ranks and verdicts of the given pages; a long page and repeated ids among them."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    more = [(90_001, "http://far.example.org/", "<a href='http://x.net/a'>" * 3000), (90_001, "http://far.example.org/", None), (90_002, None, ""), (90_003, "http://x.net/", "<a href=//far.example.org/>")]
    pages = pages.union(spark.createDataFrame(more, pages.schema))
    judged = url_filters.judged_pages(pages).collect()
    edges = Counter()
    for r in judged:
        html = r.html or ""
        found = re.findall(r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z]+:)?//([^/?#"'\s>]+)""", html)
        if "<footer" in html:
            found += re.findall(r"(?<![A-Za-z0-9.@-])((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?![A-Za-z0-9-])", html.rsplit("<footer", 1)[1])
        for dst in {re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in found}:
            if r.host and dst and dst != r.host:
                edges[r.host, dst] += 1
    assert {(e.src, e.dst): e.weight for e in url_filters.host_edges(url_filters.judged_pages(pages)).collect()} == dict(edges)
    per = defaultdict(Counter)
    for r in judged:
        per[r.host][r.by_rule] += 1
    rank = {}
    for kind, what, turn in (("trust", "allow", False), ("distrust", "block", True)):
        seed = {h: c[what] / sum(c.values()) for h, c in per.items() if h and c[what]}
        seed = {h: x / sum(seed.values()) for h, x in seed.items()}
        links = defaultdict(list)
        for (a, b), w in edges.items():
            links[b if turn else a].append((a if turn else b, w))
        now = dict(seed)
        for _ in range(12):
            flow = defaultdict(float)
            for h, x in now.items():
                for d, w in links.get(h, ()):
                    flow[d] += x * w / sum(v for _, v in links[h])
            left = 1 - 0.85 * sum(flow.values())
            now = {h: 0.85 * flow.get(h, 0.0) + left * seed.get(h, 0.0) for h in flow.keys() | seed.keys()}
        rank[kind] = now
    want = Counter()
    for r in judged:
        t, d = rank["trust"].get(r.host, 0.0), rank["distrust"].get(r.host, 0.0)
        want[r.page_id, r.rule, r.by_rule or ("block" if d > t else "allow"), round(t, 6), round(d, 6)] += 1
    got = Counter((r.page_id, r.rule, r.verdict, round(r.trust, 6), round(r.distrust, 6)) for r in url_filters.filtered(pages).collect())
    assert got == want


def test_turns_keep_their_order(spark):
    """Hashes of the query on the given conversations and conversation -1, from the rows alone."""
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    talks = defaultdict(list)
    for r in rows:
        talks[r.conv_id].append((r.turn, r.role, r.text or ""))
    talks[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in chat.op2_chat_formatting(spark, DATA).collect()}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        turns.sort()
        sha = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_strata_without_bound(spark):
    """Eighty languages: none is lumped with others, and those without labels keep the base rules alone."""
    rng = random.Random(5)
    rows = [(k * 10 + j, prose(rng, 30) + " !!" * 5, f"x{k}" if k else None, None, 0) for k in range(80) for j in range(2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(k * 10, 1, 0) for k in range(79)], "doc_id bigint, quality bigint, toxic bigint")
    chosen = quality.cutoffs(quality.features(docs), marks).collect()
    assert len({r.stratum for r in chosen}) == 79
    assert quality.quality(docs, marks).where("kept").count() == 160


def test_long_turns_shards_and_substrings(spark, tmp_path):
    """Very long and repeated rows in the chat, shard and substring operators."""
    import public_tokenizers

    rng = random.Random(12)
    long = prose(rng, 80_000)
    talk = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, None, None)], "conv_id bigint, turn bigint, role string, text string")
    assert chat.formatted(talk).first().formatted.count("w1 ") >= 2
    docs = spark.createDataFrame([(1, long), (1, long), (2, long)], "doc_id bigint, text string")
    shards, folder = sstable.written(docs, public_tokenizers.path("word_bpe_49k.json"), folder=f"file://{tmp_path}/ids")
    assert len({(r.doc_id, r.ids_crc32) for r in sstable.shards_read(shards, folder, sstable.crc32).collect()}) == 2
    assert sorted((r.doc_id, bool(r.text)) for r in substrings.deduplicated(docs).collect()) == [(1, True), (1, True), (2, False)]
