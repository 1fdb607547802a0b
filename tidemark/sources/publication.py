"""Atomic publication (A2, A11, A12, A15, H11): an intent, staged rows, then one commit that makes them visible.

Below a home lie ``intents/<name>.<attempt>``, ``data/attempt=<attempt>/`` and ``commits/<name>.json``. A commit file is
made whole beside its place and then moved there without replacing anything, which only one writer can do: by a hard link
on a local disk, by a rename that refuses an existing target elsewhere (atomic on HDFS; an object store needs a connector
whose rename is). Readers take the attempts that commits name, so rows of writers that died are never seen.

Rows stay on Spark: the driver handles small files of metadata only, one a publication.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "name string, attempt string, rows bigint, digest string, first bigint, last bigint"


class Home:
    """The folder of a publication, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def names(self, folder: str) -> dict[str, int]:
        """The files of a folder with the time of their last change in ms."""
        if not self.fs.exists(self.at(folder)):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(self.at(folder)) if not s.getPath().getName().startswith((".", "_"))}

    def put(self, below: str, text: str) -> None:
        out = self.fs.create(self.at(below), False)
        out.write(bytearray(text.encode()))
        out.close()

    def get(self, below: str) -> dict:
        source = self.fs.open(self.at(below))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        source.close()
        return json.loads(text)

    def put_once(self, below: str, text: str) -> bool:
        """Whole or not at all, and never over another's file: False if there is one."""
        folder, name = below.rsplit("/", 1)
        made = f"{folder}/_{name}.{uuid.uuid4().hex}"
        self.put(made, text)
        source, target = self.at(made), self.at(below)
        try:
            if self.fs.getUri().getScheme() == "file":
                try:
                    os.link(urlparse(source.toUri().toString()).path, urlparse(target.toUri().toString()).path)
                except FileExistsError:
                    return False
                return True
            if self.fs.exists(target):
                return False
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
            none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(source, target, none)
            except Exception:
                if self.fs.exists(target):
                    return False
                raise
            return True
        finally:
            self.fs.delete(source, False)


def digest_of(rows: DataFrame, order: str | None) -> dict:
    """Rows, a digest that ignores their order, and the range of the order column: one aggregate, combined before its shuffle."""
    one, two = F.xxhash64(*rows.columns), F.xxhash64(F.lit(1), *rows.columns)
    ends = [F.min(order).cast("bigint"), F.max(order).cast("bigint")] if order else [F.lit(None).cast("bigint")] * 2
    got = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(one.cast("decimal(20,0)")), F.lit(0)).alias("a"), F.coalesce(F.bit_xor(two), F.lit(0)).alias("b"), ends[0].alias("first"), ends[1].alias("last")).first()
    return {"rows": got["rows"], "digest": f"{got['rows']}:{got['a']}:{got['b']}", "first": got["first"], "last": got["last"]}


def staged(rows: DataFrame, home: str, name: str, order: str | None = None) -> dict:
    """The intent, then the rows below their own attempt: nothing of it is visible. The digest is of what was written."""
    spark, attempt, there = rows.sparkSession, uuid.uuid4().hex, Home(rows.sparkSession, home)
    there.put(f"intents/{name}.{attempt}", json.dumps({"name": name, "attempt": attempt}))
    path = f"{there.path}/data/attempt={attempt}"
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return {"name": name, "attempt": attempt, **digest_of(spark.read.schema(rows.schema).parquet(path), order)}


def sealed(spark: SparkSession, home: str, entry: dict) -> str:
    """``committed``; or, of a name that is taken, ``already`` for the same rows and ``conflict`` for others."""
    there = Home(spark, home)
    if there.put_once(f"commits/{entry['name']}.json", json.dumps(entry) + "\n"):
        return "committed"
    return "already" if there.get(f"commits/{entry['name']}.json")["digest"] == entry["digest"] else "conflict"


def publish(rows: DataFrame, home: str, name: str) -> str:
    return sealed(rows.sparkSession, home, staged(rows, home, name))


def append(rows: DataFrame, home: str, order: str) -> str:
    """The next segment of an archive whose ``order`` rises from segment to segment; the segments are numbered.

    Rows equal to a segment that is there are ``already``; rows that begin at or before its end are ``conflict``; a writer
    who loses a number to another looks again. Empty rows are ``empty`` and leave nothing behind but their intent.
    """
    spark, entry = rows.sparkSession, staged(rows, home, "next", order)
    there = Home(spark, home)
    if not entry["rows"]:
        return "empty"
    while True:
        taken = sorted(n for n in there.names("commits") if n.endswith(".json"))
        before = there.get(f"commits/{taken[-1]}") if taken else None
        if before and entry["first"] <= before["last"]:
            same = any(there.get(f"commits/{n}")["digest"] == entry["digest"] for n in reversed(taken))
            return "already" if same else "conflict"
        if sealed(spark, home, {**entry, "name": f"{len(taken):012d}"}) == "committed":
            return "committed"


def recover(spark: SparkSession, home: str, lease_ms: int) -> dict[str, str]:
    """What becomes of intents that are older than the lease and not committed, by attempt.

    Named publications whose rows are whole are ``rolled-forward`` unless their name is taken; others are ``abandoned``,
    and so are segments of an archive, which their writer appends again. Their rows and intents are deleted.
    """
    there, now, done = Home(spark, home), time.time() * 1000, {}
    held = {there.get(f"commits/{n}")["attempt"] for n in there.names("commits") if n.endswith(".json")}
    for file, at in there.names("intents").items():
        name, attempt = file.rsplit(".", 1)
        if attempt in held or now - at < lease_ms:
            continue
        path = f"data/attempt={attempt}"
        done[attempt] = "abandoned"
        if name != "next" and there.fs.exists(there.at(f"{path}/_SUCCESS")):
            entry = {"name": name, "attempt": attempt, **digest_of(spark.read.parquet(f"{there.path}/{path}"), None)}
            if sealed(spark, home, entry) == "committed":
                done[attempt] = "rolled-forward"
                continue
        there.fs.delete(there.at(path), True)
        there.fs.delete(there.at(f"intents/{file}"), False)
    return done


def commits(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.schema(COMMIT).json(f"{home}/commits")


def committed(spark: SparkSession, home: str, schema) -> DataFrame:
    """The rows that are published, with ``name``: folders of other attempts are pruned by the join, at run time."""
    from pyspark.sql.types import StringType, StructType

    full = StructType([*schema.fields]).add("attempt", StringType())
    rows = spark.read.schema(full).option("basePath", f"{home}/data").parquet(f"{home}/data")
    return rows.join(commits(spark, home).select("attempt", "name"), "attempt").drop("attempt")
