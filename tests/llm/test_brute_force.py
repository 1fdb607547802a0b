"""The numbered queries and operators against plain brute force, on the whole small tables and on hard cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, language, ngram_join, pieces, pii, quality, sstable, substrings, url_filters

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
SPLIT = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return SPLIT.findall(text or "")


def hard_docs(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma,", "the", "of", "x", "é", "\u00a0nb", "漢字", "zz\u2028y", "mail.a@b.example.com", "10.0.0.256", "1.2.3.4"]
    base = [rng.choice(vocabulary) + (str(i) if i % 3 else "") for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:200], "CHANGED", *base[201:]])), (3, "again the same id, " + " ".join(base[:60])), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "One"), (9, "a b"), (10, "A  b"), (None, " ".join(base)), (None, None), (11, " ".join(base[100:160]) + " tail"), (12, "x " * 300), (12, "x " * 300), (-5, " ".join(base[50:90])), (13, "w" * 50_000)]
    rows += [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    rows += [(200 + i, " ".join([*base[: i * 7], *(f"n{i}k{j}" for j in range(12)), *base[i * 7 + 12 :]])) for i in range(20)]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None, None) for i, t in rows], SCHEMA)


def tables(spark):
    yield hard_docs(spark)
    yield spark.createDataFrame([], SCHEMA)
    if Path(DATA).exists():
        yield spark.read.parquet(f"{DATA}/documents.parquet")


def shingles(text, n):
    w = words(text)
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    for docs in tables(spark):
        rows = [(r.doc_id, shingles(r.text, n)) for r in docs.collect()]
        parent = {d: d for d, _ in rows if d is not None}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, (a, x) in enumerate(rows):
            for b, y in rows[:i]:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
        want = sorted([(d, len(s), find(d) if d is not None else None) for d, s in rows], key=str)
        got = sorted([tuple(r) for r in ngram_join.near_duplicates(docs, n=n, percent=percent).collect()], key=str)
        assert got == want


def test_substrings(spark):
    for docs in tables(spark):
        rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
        least = {}
        for d, w in rows:
            for i in range(len(w) - 12):
                if d is not None:
                    least[tuple(w[i : i + 13])] = min(d, least.get(tuple(w[i : i + 13]), d))
        want = []
        for d, w in rows:
            gone = set()
            for i in range(len(w) - 12):
                if d is not None and least[tuple(w[i : i + 13])] < d:
                    gone |= set(range(i, i + 13))
            want.append((d, " ".join(x for i, x in enumerate(w) if i not in gone)))
        got = [(r.doc_id, r.text) for r in substrings.deduplicated(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_substring_levels(spark):
    body = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(body)), (2, "a b " + " ".join(body) + " c"), (3, " ".join(body[:14]))], "doc_id bigint, text string")
    levels = substrings.repeat_levels(docs)
    assert [length for length, _ in levels] == [13, 26, 52]
    found = [{r.doc_id for r in level.select("doc_id").distinct().collect()} for _, level in levels]
    assert found == [{1, 2, 3}, {1, 2}, {1, 2}]
    assert sorted((r.doc_id, r.start) for r in levels[2][1].collect()) == [(1, i) for i in range(9)] + [(2, i + 2) for i in range(9)]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_pii_base(spark):
    rng = random.Random(2)
    parts = ["a@b.c", "x.y@z", "@", "_", ".", "1.2.3.4", "001.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (903) 555-1234", "+", " ", "\n", "é", "\U0001f600", "5", "-", "(", ")", "a.b@c.d_e@f.g", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)] + [None, "", "9" * 30_000, "a" * 60_000 + "@", "+1((((" * 2000, "\U0001f600 4111111111111111 a@b.example"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.s for r in pii.detected(docs).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}


def test_pii_bootstraps(spark):
    """Cards with a bad check sum behind a context that holds cards alone are found; the same words elsewhere are not."""
    good = [f"41111111111111{n:02}" for n in range(100)]
    good = [g for g in good if base_spans(g)]
    rows = [(i, f"word{i} cardnumber {g} thanks") for i, g in enumerate(good * 3)] + [(900, "cardnumber 4111111111111 thanks"), (901, "perhaps 77777777 maybe"), (902, None)]
    many = [(1000 + i, f"pay cardnumber {int('4' + f'{i:014}') * 10 + c} thanks") for i in range(60) for c in range(10) if base_spans(str(int("4" + f"{i:014}") * 10 + c))]
    docs = spark.createDataFrame(rows + many, "doc_id bigint, text string")
    got = {r.doc_id: (r.b, r.s) for r in pii.detected(docs).select("doc_id", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s")).collect()}
    assert got[900] == ("", "card:11:24")
    assert got[901] == ("", "") and got[902] == ("", "")
    masked = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert masked[900] == "cardnumber [card] thanks" and masked[902] is None and masked[0] == "word0 cardnumber [card] thanks"


def repeat_words(w):
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_quality_base(spark):
    for docs in tables(spark):
        got = sorted([tuple(r)[:7] for r in quality.features(docs).collect()], key=str)
        want = []
        for r in docs.collect():
            w, t = words(r.text), r.text or ""
            lines = [x for x in t.split("\n") if words(x)]
            want.append((r.doc_id, r.lang, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat_words(w)))
        assert got == sorted(want, key=str)


def test_quality_cutoffs_are_certified(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 10 == 0
        text = " ".join(f"w{rng.randint(0, 9999)}" + ("!!" if bad else "") for _ in range(30))
        rows.append((i, text, "en", None, None))
        labels.append((i, 0 if bad else 1, 0))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r.kept for r in quality.quality(docs, marks, max_rejection=0.05).collect()}
    assert not any(out[i] for i in range(0, 6000, 10)) and all(out[i] for i in range(6000) if i % 10)
    few = quality.quality(docs.limit(200), marks).where("not kept").count()
    assert few == 0  # too few labels to certify anything
    assert quality.binomial_tail(0, 100, 0.05) == pytest.approx(0.95**100)
    assert quality.binomial_tail(1, 10, 0.3) == pytest.approx(0.7**10 + 10 * 0.3 * 0.7**9)


def test_chat(spark):
    rng = random.Random(4)
    parts = ["</s>", "[INST]", "[/INST]", "<|im_end|>\n", "<|im_sep|>", "\\", "<", "[", "<<SYS>>", "<</SYS>>", "hi", "\n", "é\U0001f600", "<s>", "|>"]
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", "assistant", None, "odd\nrole<|"]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))])))
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    chats = chat.formatted(table)
    got = {r.conv_id: r for r in chat.read_back(chats).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        mine = [(t.role, t.text) for t in got[c].turns]
        assert sorted(mine) == sorted((r, x) for _, _, r, x in turns)
        assert got[c].loss_text == "".join(x for r, x in mine if r == "assistant")
        inner = got[c].formatted
        for mark in (chat.START, chat.SEP, chat.END.strip(), chat.NEWLINE):
            inner = inner.replace(mark, "")
        assert not re.search(r"</?s>|\[/?INST\]|<\||<</?SYS>>", inner)
        merged = [r for i, (r, _) in enumerate(mine) if i == 0 or mine[i - 1][0] != r]
        assert got[c].formatted.count(chat.START) == len(merged)
    assert chat.formatted(table.limit(0)).count() == 0


def test_url_rules(spark):
    urls = {"http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://example.net/fr": ("example.net", "/fr", "net/", "block"), "x://badexample.com/de/": ("badexample.com", "/de/", None, None), "https://m.example.com/de/1": ("m.example.com", "/de/1", "example.com/de/", "block"), "http://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"), "nothing": ("", "", None, None), None: ("", "", None, None), "http://a.net?x=/y": ("a.net", "", None, None), "p://É.Org/FR/": ("É.org", "/FR/", None, None), "http://x#a://b/c": ("x", "", None, None)}
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.by_rule) for r in url_filters.judged_pages(pages).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filters.filtered(pages).count() == len(urls)
    assert url_filters.filtered(pages.limit(0)).count() == 0


def test_url_ranks(spark):
    edges = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 2), ("d", "a", 1)]
    seeds = {"a": 1.0, "d": 3.0}
    rank = {h: seeds.get(h, 0) / 4 for h in "abcd"}
    first = dict(rank)
    for _ in range(12):
        flow = defaultdict(float)
        for s, d, w in edges:
            flow[d] += rank[s] * w / sum(x for q, _, x in edges if q == s)
        rank = {h: 0.85 * flow[h] + (1 - 0.85 * sum(flow.values())) * first[h] for h in rank}
    got = url_filters.pageranks(spark.createDataFrame([("t", *e) for e in edges], "kind string, src string, dst string, weight bigint"), spark.createDataFrame([("t", h, w) for h, w in seeds.items()], "kind string, host string, weight double"))
    assert {r.host: round(r.rank, 9) for r in got.collect()} == {h: round(x, 9) for h, x in rank.items()}


def test_token_shards(spark, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    direct = Tokenizer.from_file(path)
    for k, docs in enumerate(tables(spark)):
        extra = docs.union(spark.createDataFrame([(70, "<|endoftext|> it's <|ENDOFTEXT|> O'NEIL'S, a.b. \u0130 e\u0301, 12.5", None, None, None)], SCHEMA))
        shards, folder = sstable.written(extra, path, folder=f"file://{tmp_path}/{k}", shard_docs=50)
        got = [tuple(r) for r in sstable.shards_read(shards, folder, sstable.crc32).orderBy("start").collect()]
        rows = sorted([(r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "", r.doc_id) for r in extra.collect()])
        want, at = [], 0
        for *_, text, doc_id in rows:
            ids = [*direct.encode(text, add_special_tokens=False).ids, 2]
            want.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
            at += len(ids)
        assert sorted(got, key=str) == sorted(want, key=str) or [g[2:] for g in got] == [w[2:] for w in want]
        for r in shards.collect():
            with open(r.path, "rb") as f:
                reader = sstable.ShardReader(f)
                for doc_id, ids in reader.all():
                    assert any((ids == x).all() for x in reader.get(doc_id) if len(x) == len(ids))
                assert reader.get(123456789) == []


def test_pieces(spark):
    import sentencepiece

    path = pieces.model_path()
    direct = sentencepiece.SentencePieceProcessor(model_file=path)
    for docs in tables(spark):
        texts = {r.text or "" for r in docs.collect()} | {" " * 999, "▁ ▁\n \n", "\x00<s>", "a" * 3000}
        table = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id bigint, text string")
        got = {r.doc_id: r for r in pieces.encoded(table, path).collect()}
        short = {r.doc_id: r for r in pieces.encoded(table, path, digests=True).collect()}
        for i, t in enumerate(sorted(texts)):
            ids = [*direct.encode(t), 2]
            assert got[i].ids == ids and got[i].decoded == direct.decode(ids) and got[i].n_tokens == len(ids)
            assert short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert pieces.encoded(table.limit(0), path).count() == 0


def test_decontamination(spark):
    rng = random.Random(8)
    vocabulary = [f"w{rng.randrange(30) if k % 2 else rng.randrange(5000)}" for k in range(20_000)]  # half common, half telling words
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 50)))) for i in range(30)] + [(99, None), (98, "too short")]
    docs, planted = [], set()
    for d in range(300):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 600))]
        if d % 10 == 0:
            i = rng.randrange(30)
            item = items[i][1].split()
            if d % 20 == 0:  # a paraphrase: some words of the first part go, some are replaced
                item = [x if k > len(item) // 2 or k % 5 else "other" for k, x in enumerate(item)]
            at = rng.randint(0, len(w))
            w[at:at] = item
            planted.add((d, i))
        docs.append((d, " ".join(w).capitalize()))
    docs += [(None, items[3][1]), (1000, None), (1000, ""), (1001, items[4][1]), (1001, items[4][1])]
    planted |= {(None, 3), (1001, 4)}
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == planted
    assert decontaminate.leaks(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_quality_cutoffs_of_few_labels(spark):
    """Some 1,000 good holdout documents certify joint cutoffs of two features; 100 do not."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(2700):
        lang, bad = ("de" if i >= 2500 else "en"), i % 8 == 0
        w = [f"w{rng.randint(0, 9999)}" for _ in range(30)]
        text = " ".join(x + "!!" if bad and i % 16 else x.upper() if bad else x for x in w)
        rows.append((i, text, lang, None, None))
        labels.append((i, 0 if bad else 1, 0))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    chosen = quality.cutoffs(quality.features(docs), marks).collect()
    assert {r.stratum for r in chosen if r.feature} == {"en"} and len({r.feature for r in chosen if r.feature}) >= 2
    for r in chosen:
        if r.feature:
            assert r.p_value <= 0.05 and r.p_value == pytest.approx(quality.binomial_tail(r.n_false, r.n_good, 0.01))
    out = {r.doc_id: r.kept for r in quality.quality(docs, marks).collect()}
    assert all(out[i] for i in out if i % 8) and not any(out[i] for i in range(0, 2500, 8)) and all(out[i] for i in range(2500, 2700))
    # every joint rule of a sequence rejects what the rules before reject, by cutoffs that only fall
    path = quality.sequence({"a": [(0.9, 1, 5), (0.5, 3, 6), (0.7, 1, 4), (0.1, 50, 60)], "b": [(2.0, 0, 3), (1.0, 9, 9)]})
    assert path[0] == ("b", 2.0) and [c for f, c in path if f == "a"] == sorted((c for f, c in path if f == "a"), reverse=True)


def test_decontamination_of_hot_items(spark):
    """An item in a third of the documents, one of common words only, and one that shares its first words with the hot one."""
    rng = random.Random(9)
    vocabulary = [f"w{rng.randrange(30) if k % 2 else rng.randrange(5000)}" for k in range(20_000)]
    hot = [f"hot{k}" for k in range(40)]
    common = [f"w{rng.randrange(30)}" for _ in range(24)]
    items = [(1, " ".join(hot)), (2, " ".join(common)), (3, " ".join([*hot[:12], *(f"own{k}" for k in range(12))]))]
    docs, planted = [], set()
    for d in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(50, 300))]
        for i, words_, each in ((1, hot, 3), (2, common, 50), (3, items[2][1].split(), 60)):
            if d % each == 0:
                at = rng.randint(0, len(w)) if i == 1 else 0  # the others never cut an item in two
                w[at:at] = [x if i != 1 or d % 2 or k % 8 else "other" for k, x in enumerate(words_)]
                planted.add((d, i))
        docs.append((d, " ".join(w)))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == planted


def test_common_subsequence():
    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        a, b = [[rng.randint(1, 6) for _ in range(rng.randint(1, 40))] for _ in "ab"]
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert decontaminate.common_subsequence(decontaminate.masks_of(np.array(a)), len(a), b) == row[-1]


def _next(old, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(old[j] + 1 if x == y else max(old[j + 1], new[j]))
    return new


@needs_data
def test_language(spark):
    pages, docs = spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "http://x.example.org/", ""), (9003, "http://", "<html lang='de'></html>")], pages.schema)
    out = {r.page_id: r for r in language.identified(pages.union(odd), docs).collect()}
    told = [r for r in out.values() if r.declared and r.page_id < 9000 and r.by_text]
    assert sum(r.lang == r.by_text for r in told) > 0.95 * len(told)
    assert len(out) == pages.count() + 3 and out[9001].lang is not None
    assert language.identified(pages.limit(0), docs).count() == 0
    # held-out text: trained on half of the documents, the other half as pages
    half = docs.where("doc_id % 2 = 0")
    other = docs.where("doc_id % 2 = 1 and n_chars > 200").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), F.col("lang").alias("truth"))
    got = language.identified(other.drop("truth"), half).join(other.select("page_id", "truth"), "page_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("truth")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.97
