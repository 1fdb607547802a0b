"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by turn (then role and text, so ties have one order;
null turns first), and adjacent turns of one role form one block:

    <|im_start|>ROLE\\n TEXT (<|im_sep|> TEXT)* <|im_end|>\\n

Inside roles and texts each backslash is doubled and a backslash goes behind the first character of each
control string, so none is left there and unescaping gives the text back. A line feed in a role becomes
<|nl|>. Null roles and texts count as empty. The loss mask is a list of half-open code point ranges of the
formatted string: the assistant's texts. A null conv_id is one conversation. Repeated rows are turns of their own, long texts are
taken whole, an empty table gives an empty one, and other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, SEP, END, NEWLINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"
#: First characters of control strings: <|...  <s>  </s>  <<SYS>>  <</SYS>>  [INST]  [/INST]
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<start, stop>> for turns(conv_id, turn, role, text)."""
    rows = turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.replace(escaped(F.coalesce(F.col("role").cast("string"), F.lit(""))), F.lit("\n"), F.lit(NEWLINE)).alias("role"),
        escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    here = lambda i: F.col("turns")[i]["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (here(i) != here(F.greatest(i - 1, F.lit(0)))))
    grouped = grouped.withColumn("starts", starts)
    stop = lambda j: F.coalesce(F.get("starts", j + 1), F.size("turns"))
    blocks = F.transform("starts", lambda i, j: F.slice("turns", i + 1, stop(j) - i))
    grouped = grouped.withColumn("blocks", blocks)
    # one piece a turn: what stands before its text, the text, what stands behind it
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b, lambda t, k: F.struct(
        F.when(k == 0, F.concat(F.lit(START), t["role"], F.lit("\n"))).otherwise(F.lit(SEP)).alias("head"),
        t["text"].alias("text"),
        F.when(k == F.size(b) - 1, F.lit(END)).otherwise(F.lit("")).alias("tail"),
        (t["role"] == "assistant").alias("loss")))))
    grouped = grouped.withColumn("pieces", pieces)
    length = lambda c: F.char_length(c).cast("bigint")

    def ahead(acc: Column, p: Column) -> Column:
        start = acc["at"] + length(p["head"])
        stop = start + length(p["text"])
        return F.struct((stop + length(p["tail"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "").alias("formatted"),
        F.aggregate("pieces", zero, ahead)["spans"].alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text, from conv_id, formatted, loss_mask alone."""
    literal = lambda s: s.replace("|", r"\|")
    cut = F.split("formatted", literal(START), -1)
    blocks = F.slice(cut, F.lit(2), F.size(cut) - 1)
    bodies = F.transform(blocks, lambda b: F.substring(b, F.lit(1), F.char_length(b) - len(END)))

    def turns_of(body: Column) -> Column:
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.char_length(role) + 2, F.char_length(body)), literal(SEP), -1)
        return F.transform(texts, lambda t: F.struct(unescaped(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescaped(t).alias("text")))

    masked = F.transform("loss_mask", lambda m: unescaped(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int"))))
    return chats.select("conv_id", "formatted", F.flatten(F.transform(bodies, turns_of)).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    rows = rows.union(spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], rows.schema))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted(rows)).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))
