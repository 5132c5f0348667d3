"""Clause splitting of contract and statute texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.functions import text as tx
from clauselake.functions.rules import is_non_clause


def with_bodies(docs: DataFrame, text: str, label: str) -> DataFrame:
    """Add ``bodies`` (introduction and clauses of a text) and ``sizes`` (blocks per body).

    Works row by row inside the scan stage, without a shuffle.  The stages are
    separate projections: each intermediate array is used several times, and
    deeply nested lambdas make the optimizer slow.
    """
    c = F.col
    name = F.when(tx.is_blank(c(label)), F.lit("doc")).otherwise(c(label))
    body = F.coalesce(c(text), F.lit(""))
    return (
        docs.withColumn("__pieces", tx.heading_pieces(body))
        .withColumn("__numbers", tx.heading_numbers(c("__pieces")))
        .withColumn("__starts", tx.accepted_starts(c("__numbers")))
        .withColumn("bodies", tx.clause_bodies(body, name, c("__pieces"), c("__numbers"), c("__starts")))
        .withColumn("sizes", tx.body_sizes(c("bodies")))
        .drop("__pieces", "__numbers", "__starts")
    )


def block_total(sizes: str = "sizes") -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)


def clause_count(bodies: str = "bodies", sizes: str = "sizes") -> Column:
    """Blocks that are real clauses, not the introduction or an unnumbered whole text."""
    lead = F.get(F.col(bodies), F.lit(0))["cid"]
    return block_total(sizes) - F.when(is_non_clause(lead), 1).otherwise(0)


def explode_blocks(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per block; ``chunk_index`` counts blocks in document order.

    Outer explodes with a filter on the position: a plain explode makes the
    optimizer infer a size check and push the whole splitting expression into
    the scan a second time.
    """
    c = F.col
    clauses = docs.select(*keep, "sizes", F.posexplode_outer("bodies").alias("at", "b")).filter("at IS NOT NULL").select(
        *keep,
        c("b.cid").alias("canonical_id"),
        F.aggregate(F.slice("sizes", 1, c("at")), F.lit(0), lambda a, x: a + x).alias("offset"),
        tx.is_splittable(c("b.cid"), c("b.body")).alias("long"),
        c("b.body").alias("body"),
    )
    parts = F.when(c("long"), tx.split_long_clause(c("body"))).otherwise(F.array("body"))
    return (
        clauses.select(*keep, "canonical_id", "offset", "long", F.posexplode_outer(parts).alias("k", "content"))
        .filter("k IS NOT NULL")
        .withColumn("sub_index", F.when(c("long"), c("k") + 1).otherwise(0).cast("int"))
        .select(
            *keep,
            (c("offset") + c("k")).alias("chunk_index"),
            "canonical_id",
            "sub_index",
            chunk_id(c("canonical_id"), c("sub_index")).alias("chunk_id"),
            "content",
        )
    )


def split_clauses(docs: DataFrame, keep: list[str], text: str, label: str) -> DataFrame:
    """One row per clause block: ``chunk_index, canonical_id, sub_index, chunk_id, content``."""
    needed = docs.select(*dict.fromkeys([*keep, text, label]))
    return explode_blocks(with_bodies(needed, text, label), keep)


def chunk_id(canonical_id, sub_index):
    """``canonical_id`` for a whole clause, ``canonical_id#n`` for a sub-block."""
    return F.when(sub_index == 0, canonical_id).otherwise(
        F.concat(canonical_id, F.lit("#"), sub_index.cast("string"))
    )


def resolve_clause_id(canonical_id, hit_id):
    """Canonical id of a hit, or the hit's own id when it has none."""
    return F.coalesce(canonical_id, hit_id)


def truncate_contracts(
    docs: DataFrame, text: str, max_chars: int = lx.MAX_CONTRACT_CHARS, min_chars: int = lx.MIN_CONTRACT_CHARS
) -> DataFrame:
    """Add ``analysis_text`` (cut to ``max_chars`` and marked), ``dropped_chars`` and ``too_short``.

    The analysis feature does not analyse a text under ``min_chars``; such a
    row stays, flagged, with a null ``analysis_text``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    too_short = F.length(tx.trim_ws(t)) < min_chars
    cut = F.when(
        F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit(lx.TRUNCATION_SUFFIX))
    ).otherwise(t)
    return docs.select(
        "*", F.when(~too_short, cut).alias("analysis_text"),
        F.greatest(F.length(t) - max_chars, F.lit(0)).alias("dropped_chars"), too_short.alias("too_short"),
    )


def missing_elements(docs: DataFrame, text: str, clause_count: str, items=None) -> DataFrame:
    """Checklist items a whole contract lacks, as an ordered array ``missing``.

    Checked from two clauses on, or for unnumbered text of some length; fewer
    than two missing items are not reported.  A checklist entry is a name and
    its words, separated by ``|``.
    """
    t, n = F.col(text), F.col(clause_count)
    checklist = items or lx.COMPLETENESS_ITEMS
    applies = ~tx.is_blank(t) & (
        (n >= lx.COMPLETENESS_MIN_CLAUSES) | ((n == 0) & (F.length(t) >= lx.UNNUMBERED_MIN_CHARS))
    )
    lacking = tx.names_lacking(t, [(name, words.split("|")) for name, words in checklist])
    return docs.withColumn("missing", F.when(applies, lacking)).withColumn(
        "missing",
        F.when(F.size("missing") >= lx.COMPLETENESS_MIN_MISSING, F.col("missing")).otherwise(
            F.array().cast("array<string>")
        ),
    )
