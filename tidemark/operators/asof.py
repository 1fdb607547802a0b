"""As-of merge: what was known at any number of cutoffs, in one pass.

Revisions and cutoffs are one stream by key and time of knowledge. A running greatest revision is carried over it, in blocks of time
(scan.py), so neither the number of cutoffs nor a key with most revisions multiplies or gathers rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import DAY_NS
from tidemark.operators.scan import prefix


def as_of_merge(revisions: DataFrame, cutoffs: list[int] | DataFrame, keys: list[str], known: str, revision: str, first: bool = False, span: int = 400 * DAY_NS) -> DataFrame:
    """keys, cutoff and the other columns of the latest (or ``first``) revision known at the cutoff, by (known, revision).

    Cutoffs hold for all keys (a list) or are a table with the keys and a column cutoff. What is known exactly at a cutoff
    counts. A key has no row at cutoffs before its first revision; revisions that are never known (null) do not count.
    """
    rest = [c for c in revisions.columns if c not in {*keys, known, revision}]
    rows = revisions.where(F.col(known).isNotNull())
    if isinstance(cutoffs, list):
        asked = rows.groupBy(*keys).agg(F.min(known).alias("_first"))
        asked = asked.select(*keys, F.explode(F.filter(F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cutoffs))]), lambda c: c >= F.col("_first"))).alias("cutoff"))
    else:
        asked = cutoffs.select(*keys, F.col("cutoff").cast("bigint").alias("cutoff")).distinct()
    value = F.struct(F.col(known).alias("known"), F.col(revision).alias("revision"), *[F.col(c).alias(c) for c in rest])
    one = rows.select(*keys, (2 * F.col(known)).alias("_at"), value.alias("_x"), F.lit(None).cast("bigint").alias("cutoff"))
    two = asked.select(*keys, (2 * F.col("cutoff") + 1).alias("_at"), F.lit(None).cast(one.schema["_x"].dataType).alias("_x"), "cutoff")
    found = prefix(one.union(two), keys, "_at", 2 * span, {"_seen": (F.min if first else F.max, F.col("_x"))})
    out = found.where("cutoff is not null and _seen is not null")
    return out.select(*keys, "cutoff", F.col("_seen.known").alias(known), F.col("_seen.revision").alias(revision), *[F.col(f"_seen.{c}").alias(c) for c in rest])
