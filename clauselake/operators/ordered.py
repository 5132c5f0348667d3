"""Ordered per-key computations that survive a hot key.

A plain window over a key sends the whole key to one task.  Here a key is cut
into consecutive blocks of its order column: windows run inside ``(key, block)``,
each block is summarised by an aggregate, and only the summaries - one row per
block - are scanned per key.  Combining both gives exactly the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: turns of one session that share a block
TURNS_PER_BLOCK = 4096


@dataclass(frozen=True)
class Scan:
    """One running column.

    ``kind``: ``sum`` up to the row, ``last`` / ``first`` non-null value up to
    the row, or ``prev`` - the last non-null value strictly before the row.
    """

    name: str
    kind: str
    value: Column


def turn_block(turn: str = "turn", size: int = TURNS_PER_BLOCK) -> Column:
    return F.floor(F.col(turn) / size)


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, scans: list[Scan]) -> DataFrame:
    """Add one running column per scan; ``order`` must be unique inside a key."""
    part = [*keys, "__block"]
    staged = df.withColumn("__block", block)
    for i, s in enumerate(scans):
        staged = staged.withColumn(f"__in{i}", s.value)

    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    sort_key = F.struct(*order)

    local, summary, carried, combined = [], [], [], []
    blocks = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    for i, s in enumerate(scans):
        v, own, total, carry = F.col(f"__in{i}"), f"__own{i}", f"__total{i}", f"__carry{i}"
        present = F.when(v.isNotNull(), sort_key)
        if s.kind == "sum":
            local.append(F.sum(v).over(upto).alias(own))
            summary.append(F.sum(v).alias(total))
            carried.append(F.sum(total).over(blocks).alias(carry))
            combined.append((F.coalesce(F.col(own), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))).alias(s.name))
        elif s.kind in ("last", "prev"):
            frame = upto if s.kind == "last" else before
            local.append(F.last(v, ignorenulls=True).over(frame).alias(own))
            summary.append(F.max_by(v, present).alias(total))
            carried.append(F.last(total, ignorenulls=True).over(blocks).alias(carry))
            combined.append(F.coalesce(F.col(own), F.col(carry)).alias(s.name))
        elif s.kind == "first":
            local.append(F.first(v, ignorenulls=True).over(upto).alias(own))
            summary.append(F.min_by(v, present).alias(total))
            carried.append(F.first(total, ignorenulls=True).over(blocks).alias(carry))
            combined.append(F.coalesce(F.col(carry), F.col(own)).alias(s.name))
        else:
            raise ValueError(s.kind)

    carries = staged.groupBy(*part).agg(*summary).select(*part, *carried)
    rows = staged.select(*df.columns, "__block", *local)
    return rows.join(carries, part, "left").select(*[F.col(c) for c in df.columns], *combined)


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows per key with ``from_end`` = 1 for the newest.

    The bound lets Spark drop rows before the shuffle (window group limit).
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("from_end", F.row_number().over(newest)).filter(F.col("from_end") <= n)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key in the given order, ranked from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
