"""Prefix scans and neighbours over blocks of time, so that one long series uses all cores.

A plain window over a series is one partition a series. Here rows are windowed inside (key, block); what crosses a block's
borders comes from summaries of a row a block, scanned by key and joined back (prefix, neighbours), or from copies
of the rows near the border (haloed). Rows are shuffled once by (key, block); of a summary's window only a row a block is.
Keys and order columns are not null; order columns are bigint (ns, offsets) and ``span`` is the length of a block in their unit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.expressions import HOUR_NS

#: Hours in a block of hourly bars: some 170 days, half a megabyte of rows.
BLOCK_HOURS = 4096
#: Offsets in a block of an archive.
BLOCK_OFFSETS = 1 << 20


def block_of(order: Column | str, span: int) -> Column:
    """Where the block of a position begins."""
    at = F.col(order) if isinstance(order, str) else order
    return at - F.pmod(at, F.lit(span))


def _joined(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(carried, [*keys, "_block"], "left")


def prefix(rows: DataFrame, keys: list[str], order: str, span: int, what: dict[str, tuple[Callable, Column]], inclusive: bool = True, reverse: bool = False) -> DataFrame:
    """rows with running aggregates: name -> (F.sum, F.min or F.max, value) over all rows of the key up to this one.

    ``inclusive`` counts the row itself, ``reverse`` runs from the end. Nulls count as nothing; a sum of nothing is 0, a least or
    greatest of nothing is null.
    """
    turned = (lambda c: F.col(c).desc()) if reverse else F.col
    rows = rows.withColumn("_block", block_of(order, span))
    totals = rows.groupBy(*keys, "_block").agg(*[f(value).alias(f"_all_{name}") for name, (f, value) in what.items()])
    before = W.partitionBy(*keys).orderBy(turned("_block")).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", *[f(f"_all_{name}").over(before).alias(f"_all_{name}") for name, (f, _) in what.items()])
    inside = W.partitionBy(*keys, "_block").orderBy(turned(order)).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = _joined(rows.withColumns({f"_own_{name}": f(value).over(inside) for name, (f, value) in what.items()}), carried, keys)

    def whole(name: str, f: Callable) -> Column:
        own, rest = F.col(f"_own_{name}"), F.col(f"_all_{name}")
        if f is F.sum:
            return F.coalesce(own, F.lit(0)) + F.coalesce(rest, F.lit(0))
        return (F.least if f is F.min else F.greatest)(own, rest)

    return out.select(*[c for c in rows.columns if c != "_block"], *[whole(name, f).alias(name) for name, (f, _) in what.items()])


def neighbours(rows: DataFrame, keys: list[str], order: str, span: int, before: dict[str, str] | None = None, behind: dict[str, str] | None = None) -> DataFrame:
    """rows with columns of the key's row before (name -> column) and of the row behind, wherever they lie; null at the ends."""
    rows = rows.withColumn("_block", block_of(order, span))
    sides = [(side, F.struct(*[F.col(c).alias(n) for n, c in names.items()])) for side, names in (("_before", before), ("_behind", behind)) if names]
    ends = rows.groupBy(*keys, "_block").agg(*[(F.max_by if side == "_before" else F.min_by)(value, F.col(order)).alias(side) for side, value in sides])
    by, inside = W.partitionBy(*keys).orderBy("_block"), W.partitionBy(*keys, "_block").orderBy(order)
    carried = ends.select(*keys, "_block", *[(F.lag if side == "_before" else F.lead)(side).over(by).alias(f"{side}_block") for side, _ in sides])
    near = rows.withColumns({side: (F.lag if side == "_before" else F.lead)(value).over(inside) for side, value in sides})
    out = _joined(near, carried, keys)
    found = [F.coalesce(side, f"{side}_block")[n].alias(n) for side, names in (("_before", before), ("_behind", behind)) for n in names or ()]
    return out.select(*[c for c in rows.columns if c != "_block"], *found)


def haloed(rows: DataFrame, order: str, span: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """rows in their own block (``_own``), and copies in blocks that look ``back`` or ``ahead`` as far as them.

    A window by (key, _block) then sees all rows within these distances; rows that are not _own are to be dropped behind it.
    """
    blocks = F.sequence(block_of(F.col(order) - ahead, span), block_of(F.col(order) + back, span), F.lit(span))
    return rows.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == block_of(order, span))


def grid(ends: DataFrame, keys: list[str], interval: int = HOUR_NS, span: int = BLOCK_HOURS * HOUR_NS, name: str = "start_ns") -> DataFrame:
    """keys and every position from ``lo`` to ``hi`` of each row of ends: blocks first, which are dealt out, then what is in them."""
    within = F.sequence(F.col("lo") + F.expr(f"(greatest(_block, lo) - lo + {interval - 1}) div {interval}") * interval, F.least("hi", F.col("_block") + span - 1), F.lit(interval))
    blocks = ends.select(*keys, "lo", "hi", F.explode(F.sequence(block_of("lo", span), block_of("hi", span), F.lit(span))).alias("_block"))
    there = F.col("lo") + F.expr(f"(greatest(_block, lo) - lo + {interval - 1}) div {interval}") * interval <= F.least("hi", F.col("_block") + span - 1)
    return blocks.repartition(*keys, "_block").where(there).select(*keys, F.explode(within).alias(name))
