"""Personal data: fixed rules, then bootstrapped contextual extraction. DataFrame operations only.

Base spans are what four patterns find, leftmost and without overlap within a kind, and what passes the kind's
check. They are the first seeds, with secrets: quoted values that are assigned to a name of ``SECRET_NAMES``.

In a copy of the text base spans are replaced by placeholders of equal length. Candidates are runs of numbers (so a
phone number of several words is one) and other words with a digit or an @, without the marks around them. Instances are
the candidates and the base spans. Lexical patterns of an instance are what stands outside it and its shape:

    L1, L2, L3  the one, two, three tokens before          R  the token behind          LR  one on either side
    S  the shape: digits 9, runs of letters a or A, long hexadecimal strings by their length      SL  shape and L1

A pattern with a kind is scored in each round on the graph of patterns and distinct instance strings:

    confidence(pattern, kind) = known instances of the kind that it holds / (all instances that it holds + prior)
    score(instance, kind) = 1 - product of (1 - confidence) over its patterns of that kind

Patterns need ``support`` known instances and ``confident`` confidence, and instances that reach ``confident`` become
known for the next round. Spans of candidates known at the end are added with the kind's name; base spans stay.

Null texts count as empty and an empty table gives an empty one. The same text gives the same spans, so rows that
repeat an id are judged each by its own text, and rows that repeat both get the same. Ties of kinds go to the greater
score, then the greater name. Starts and ends count code points, ends are exclusive. Positions come from running sums
in blocks and texts are cut in blocks, so the work is linear in a text's length and matches but for matches / 256 squared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, durable, joined_rows, keyed

#: kind -> pattern. The quantifiers are possessive where that finds the same matches without retries, and a match
#: that begins inside a run of its own first characters is only tried right behind the match before it (\G).
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: All kinds of spans in the order in which ties of starts are listed.
ORDER = (*KINDS, "secret")
#: What a text must have for the pattern to be tried.
NEEDS = {"email": "@", "ip": None, "card": None, "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Names whose quoted values are secrets: fixed values.
SECRET_NAMES = "password|passwd|pwd|secret|token|api_key|apikey|api-key|access_key|access-key|private_key|auth_key"
BLANKS = r"\x20\x09-\x0D"
#: A base span in the copy of the text: one first character, then as many as it is longer.
HEAD, REST = "\ufffc", "\ufffd"
WORD = rf"[^{BLANKS}{HEAD}{REST}0-9@]*+[0-9@][^{BLANKS}{HEAD}{REST}]*+"
#: A word of digits and the marks of numbers.
NUMBER = rf"[+(]*+[0-9][0-9().,+/:-]*+(?![^{BLANKS}{HEAD}{REST}])"
#: A placeholder, a run of numbers, or a word with a digit or an @.
CANDIDATE = rf"{HEAD}{REST}*+|(?<![^{BLANKS}{HEAD}{REST}])(?:{NUMBER}(?:\x20{NUMBER})*+|{WORD})"
SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint,match:string>"
FOUND = "struct<start:bigint,match:string>"
#: Entries of a running sum, and characters of a text, that are handled at a time.
CHUNK, PIECE = 256, 4096
#: Characters looked at on either side of a candidate, and the least of a candidate.
BESIDE, LEAST = 96, 6


def size_of(c: Column) -> Column:
    return F.char_length(c).cast("bigint")


def running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of an array<bigint> of non-negative numbers, in chunks."""
    empty = F.array().cast("array<bigint>")

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, empty, lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, plus(F.element_at(a, -1), x)).otherwise(x))))

    count = F.floor((F.size(values) + (CHUNK - 1)) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: scan(F.slice(values, (k - 1) * CHUNK + 1, F.lit(CHUNK))))
    ends = F.transform(chunks, lambda c: F.coalesce(F.get(c, F.size(c) - 1), F.lit(0).cast("bigint")))
    before = F.concat(F.array(F.lit(0).cast("bigint")), scan(ends))
    return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, b: F.transform(c, lambda x: plus(b, x))))


def add(a: Column, b: Column) -> Column:
    return a + b


def pieces_of(text: Column) -> Column:
    """The text in pieces of PIECE characters."""
    count = F.floor((F.char_length(text) + (PIECE - 1)) / PIECE).cast("int")
    return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.substring(text, (k - 1) * PIECE + 1, F.lit(PIECE)))


def cut(pieces: Column, start: Column, stop: Column) -> Column:
    """The characters [start, stop) of the text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    count = F.floor((stop - 1) / PIECE).cast("int") - first + 1
    some = F.array_join(F.slice(pieces, first + 1, F.greatest(count, F.lit(1))), "")
    return F.when(stop > start, F.substring(some, (start - first * PIECE + 1).cast("int"), (stop - start).cast("int"))).otherwise(F.lit(""))


def located(rows: DataFrame, name: str, text: str, pattern: str, need: Column) -> DataFrame:
    """rows with the pattern's matches in column ``text`` as <name> array<struct<start, match>>, and <name>_gaps: the texts
    between them, one more than matches (empty without a match). Gaps are what split leaves out; starts are running sums."""
    empty, none = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    rows = rows.withColumn(f"{name}_m", F.when(need, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty))
    some = F.size(f"{name}_m") > 0
    rows = rows.withColumn(f"{name}_gaps", F.when(some, F.split(text, pattern, -1)).otherwise(empty))
    rows = rows.withColumn(f"{name}_n", F.when(some, F.zip_with(F.slice(f"{name}_gaps", F.lit(1), F.size(f"{name}_m")), f"{name}_m", lambda g, m: size_of(g) + size_of(m))).otherwise(none))
    rows = rows.withColumn(f"{name}_e", F.when(some, running(F.col(f"{name}_n"), add)).otherwise(none))
    return rows.withColumn(name, F.zip_with(f"{name}_e", f"{name}_m", lambda e, m: F.struct((e - size_of(m)).alias("start"), m.alias("match")))).drop(f"{name}_m", f"{name}_n", f"{name}_e")


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits is a multiple of ten."""
    places = F.sequence(F.lit(1), F.char_length(digits))

    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z")
    if kind == "card":
        return F.when(F.char_length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def checked(found: Column, kind: str, rank: int) -> Column:
    """The matches that pass the kind's check, as spans."""
    span = lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + size_of(m["match"])).alias("stop"), m["match"].alias("match"))
    return F.transform(F.filter(found, lambda m: passes(kind, m["match"])), span).cast(f"array<{SPAN}>")


def with_base(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with base: array<struct<start, rank, kind, stop, match>> in order of start, then kind as listed."""
    text = F.col("text")
    digits = text.rlike("[0-9]")
    for rank, kind in enumerate(KINDS):
        need = digits if NEEDS[kind] is None else F.contains(text, F.lit(NEEDS[kind])) & (digits if kind == "phone" else F.lit(True))
        rows = located(rows, f"in_{kind}", "text", KINDS[kind], need).drop(f"in_{kind}_gaps")
        rows = rows.withColumn(f"in_{kind}", checked(F.col(f"in_{kind}"), kind, rank))
    return rows.withColumn("base", F.array_sort(F.concat(*[f"in_{k}" for k in KINDS]))).drop(*[f"in_{k}" for k in KINDS])


def with_groups(rows: DataFrame, spans: str, name: str) -> DataFrame:
    """rows with <name>: array<struct<start, stop, kind, match>>, sorted spans with overlapping ones as one, kind and match of the first."""
    rows = rows.withColumn("reach", F.when(F.size(spans) > 0, running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))).otherwise(F.array().cast("array<bigint>")))
    first = F.filter(F.transform(spans, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: (x["i"] == 0) | (x["s"]["start"] >= F.get("reach", x["i"] - 1)))
    rows = rows.withColumn("firsts", first)
    stop = lambda i: F.get("reach", F.coalesce(F.get("firsts", i + 1)["i"], F.size("reach")) - 1)
    return rows.withColumn(name, F.transform("firsts", lambda x, i: F.struct(x["s"]["start"].alias("start"), stop(i).alias("stop"), x["s"]["kind"].alias("kind"), x["s"]["match"].alias("match")))).drop("reach", "firsts")


def replaced(groups: str, pieces: str, text: Column, by: Callable[[Column], Column]) -> Column:
    """The text with each group of spans replaced."""
    before = lambda i: F.coalesce(F.get(groups, i - 1)["stop"], F.lit(0).cast("bigint"))
    parts = F.transform(groups, lambda g, i: F.concat(cut(F.col(pieces), before(i), g["start"]), by(g)))
    tail = cut(F.col(pieces), F.get(groups, F.size(groups) - 1)["stop"], size_of(text))
    return F.when(F.size(groups) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text)


def shape(text: Column) -> Column:
    drawn = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    hexadecimal = text.rlike(r"\A(?:[0-9a-f]{16,}|[0-9A-F]{16,})\z") & text.rlike("[0-9]") & text.rlike("[A-Fa-f]")
    return F.when(hexadecimal, F.concat(F.lit("hex"), F.char_length(text).cast("string"))).when(F.char_length(drawn) <= 40, drawn)


def described(m: Column, left: Column, right: Column, group: Column) -> Column:
    """struct of one instance: where it lies, its kind if known, and its patterns; m has start and match."""
    held = group.isNotNull()
    core = F.when(held, group["match"]).otherwise(F.regexp_extract(m["match"], r"(?s)[0-9A-Za-z+(](?:.*[0-9A-Za-z)])?", 0))
    lead = F.when(held, F.lit("")).otherwise(F.regexp_extract(m["match"], r"(?s)\A[^0-9A-Za-z+(]*", 0))
    trail = F.when(held, F.lit("")).otherwise(F.regexp_extract(m["match"], r"(?s)[^0-9A-Za-z)]*\z", 0))
    tokens = lambda c: F.filter(F.split(F.lower(c), rf"[{BLANKS}]+"), lambda t: t != "")
    return F.struct(
        (m["start"] + size_of(lead)).alias("start"), F.when(held, group["stop"]).otherwise(m["start"] + size_of(lead) + size_of(core)).alias("stop"), core.alias("match"), group["kind"].alias("base_kind"),
        F.concat(F.substring(left, -BESIDE, BESIDE), lead).alias("before"), tokens(F.concat(F.substring(left, -BESIDE, BESIDE), lead)).alias("l"), tokens(F.concat(trail, F.substring(right, 1, BESIDE))).alias("r"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base and found (instances with the tokens beside them) of docs(doc_id, row_key, text)."""
    rows = with_groups(with_base(docs.select("doc_id", "row_key", "text")), "base", "groups")
    rows = rows.withColumn("plain", F.translate("text", HEAD + REST, "??")).withColumn("pieces", F.when(F.size("groups") > 0, pieces_of(F.col("plain"))))
    place = lambda g: F.rpad(F.lit(HEAD), (g["stop"] - g["start"]).cast("int"), REST)
    rows = rows.withColumn("copy", replaced("groups", "pieces", F.col("plain"), place)).drop("plain", "pieces", "text")
    rows = located(rows, "m", "copy", CANDIDATE, F.col("copy").rlike(rf"[0-9@{HEAD}]")).drop("copy")
    # placeholders come in the order of the groups
    held = F.transform("m", lambda x: F.startswith(x["match"], F.lit(HEAD)).cast("bigint"))
    rows = rows.withColumn("nth", F.when(F.size("m") > 0, running(held, add)).otherwise(F.array().cast("array<bigint>")))
    group = lambda x, i: F.when(F.startswith(x["match"], F.lit(HEAD)), F.get("groups", (F.get("nth", i) - 1).cast("int")))
    gap = lambda i: F.coalesce(F.get("m_gaps", i), F.lit(""))
    found = F.transform("m", lambda x, i: described(x, gap(i), gap(i + 1), group(x, i)))
    return rows.select("doc_id", "row_key", "base", F.filter(found, lambda x: x["base_kind"].isNotNull() | (F.char_length(x["match"]) >= LEAST)).alias("found"))


def instances(scan: DataFrame) -> DataFrame:
    """doc_id, row_key, start, stop, match, kind (of seeds; null: a candidate) base_kind and patterns, a row an instance."""
    rows = scan.where(F.size("found") > 0).select("doc_id", "row_key", F.explode("found").alias("x")).select("doc_id", "row_key", "x.*")
    assigned = F.col("before").rlike(rf"(?is)(?:^|[^A-Za-z0-9])(?:{SECRET_NAMES})[{BLANKS}]*[=:][{BLANKS}]*[\"']\z")
    secret = assigned & ~F.col("match").rlike(rf"[{BLANKS}]") & (F.char_length("match") >= 16) & F.col("match").rlike("[0-9]")
    last = lambda c, k: F.array_join(F.slice(c, F.greatest(F.size(c) - (k - 1), F.lit(1)), F.lit(k)), " ")
    named = lambda name, c, on: F.when(on, F.concat(F.lit(f"{name}:"), c))
    drawn = shape(F.col("match"))
    patterns = [
        *[named(f"L{k}", last(F.col("l"), k), F.size("l") >= k) for k in (1, 2, 3)], named("R", F.get("r", F.lit(0)), F.size("r") > 0),
        named("LR", F.concat(last(F.col("l"), 1), F.lit(" "), F.get("r", F.lit(0))), (F.size("l") > 0) & (F.size("r") > 0)),
        named("S", drawn, drawn.isNotNull()), named("SL", F.concat(drawn, F.lit(" "), last(F.col("l"), 1)), drawn.isNotNull() & (F.size("l") > 0)),
    ]
    return rows.select(
        "doc_id", "row_key", "start", "stop", "match", F.coalesce("base_kind", F.when(secret, "secret")).alias("kind"), "base_kind",
        F.xxhash64("match").alias("instance"), F.filter(F.array(*patterns), lambda p: p.isNotNull()).alias("patterns"))


def bootstrapped(found: DataFrame, rounds: int = 3, support: int = 5, confident: float = 0.9, prior: float = 0.5) -> DataFrame:
    """instance, kind: what is known in the end, seeds included. found as from instances(); instances are hashes of strings."""
    graph = durable(found.select("instance", F.explode("patterns").alias("pattern")).select("instance", F.xxhash64("pattern").alias("pattern")).distinct(), "pii-graph")
    seeds = durable(found.where("kind is not null").select("instance", "kind").distinct(), "pii-seeds")
    # a pattern without enough seeds or instances can't reach the confidence in any round
    held = durable(graph.groupBy("pattern").agg(F.count("*").alias("held")).where(F.col("held") >= support), "pii-held")
    linked = durable(graph.join(held, "pattern"), "pii-shared")
    discard(graph)
    known = seeds
    for _ in range(rounds):
        hits = linked.join(known, "instance").groupBy("pattern", "held", "kind").agg(F.count("*").alias("hits")).where(F.col("hits") >= support)
        good = hits.withColumn("confidence", F.col("hits") / (F.col("held") + prior)).where(F.col("confidence") >= confident).select("pattern", "kind", "confidence")
        votes = linked.join(good, "pattern").join(seeds.select("instance"), "instance", "left_anti")
        scores = votes.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")).where(F.col("score") >= confident)
        best = scores.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        before, known = known, durable(seeds.union(best.select("instance", "kind")), "pii-known")
        if before is not seeds:
            discard(before)
    return known


def detected(docs: DataFrame, **options) -> DataFrame:
    """doc_id, row_key, base, spans (base and added ones, in order) for docs(doc_id, text), a row for each row."""
    rows = keyed(docs).select("doc_id", "row_key", "text")
    scan = durable(scanned(rows), "pii-scan")
    found = instances(scan)
    known = bootstrapped(found, **options).select("instance", F.col("kind").alias("as_kind"))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("as_kind")) - 1
    span = F.struct(F.col("start"), rank.cast("int").alias("rank"), F.col("as_kind").alias("kind"), F.col("stop"), F.col("match")).cast(SPAN)
    more = found.where("base_kind is null").join(known, "instance").select("doc_id", "row_key", span.alias("span"))
    more = durable(more.groupBy("doc_id", "row_key").agg(F.collect_set("span").alias("more")), "pii-added")
    out = joined_rows(scan.select("doc_id", "row_key", "base"), more, "left")
    return out.select("doc_id", "row_key", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(docs: DataFrame, **options) -> DataFrame:
    """docs with each span of its text replaced by [kind]; overlapping spans become one with the first's kind.

    All columns stay, whatever their names; null texts stay null.
    """
    found = detected(docs, **options).where(F.size("spans") > 0).select("doc_id", "row_key", "spans").dropDuplicates(["doc_id", "row_key"])
    rows = joined_rows(keyed(docs), found, "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))
    rows = with_groups(rows, "spans", "groups").withColumn("pieces", F.when(F.size("groups") > 0, pieces_of(F.col("text"))))
    rows = rows.withColumn("text", replaced("groups", "pieces", F.col("text"), lambda g: F.concat(F.lit("["), g["kind"], F.lit("]"))))
    changed = F.when(F.size("groups") > 0, F.col("text")).otherwise(F.col("row.text"))
    return rows.select(*[(changed if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detected(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    n_secret = F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("bigint").alias("n_secret")
    return out.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n_secret, F.size("spans").cast("bigint").alias("n_spans"))
