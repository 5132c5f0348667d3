"""Lexical, vector and fused retrieval over a written search index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.operators.ordered import top_rows
from clauselake.operators.postings import PostingsIndex, bm25_hits, postings_index
from clauselake.operators.vectors import VectorIndex, knn_hits, vector_index
from clauselake.runtime import broadcast_if_small, written


@dataclass(frozen=True)
class SearchIndex:
    """Postings and vector cells of a chunk table; both keep clause ids, so hits need no look-up."""

    lexical: PostingsIndex
    vectors: VectorIndex | None


def search_index(chunks: DataFrame, knn_enabled: bool = True) -> SearchIndex:
    """Index ``chunks`` (``chunk_id, kb_id, canonical_id, content, vector``) once for any number of searches."""
    return SearchIndex(postings_index(chunks), vector_index(chunks) if knn_enabled else None)


def bm25_topk(
    queries: DataFrame, chunks: DataFrame | PostingsIndex, k: int, k1: float = lx.BM25_K1, b: float = lx.BM25_B
) -> DataFrame:
    """Best ``k`` chunks per query: ``query_id, chunk_id, score, rank``."""
    index = chunks if isinstance(chunks, PostingsIndex) else postings_index(chunks)
    return bm25_hits(queries, index, k, k1, b).drop("clause_id")


def knn_topk(queries: DataFrame, chunks: DataFrame | VectorIndex, k: int) -> DataFrame:
    """Exact cosine top ``k`` inside the query's ``kb_id``: ``query_id, chunk_id, score, rank``."""
    index = chunks if isinstance(chunks, VectorIndex) else vector_index(chunks)
    return knn_hits(queries, index, k).drop("clause_id")


# ---- fusion ----------------------------------------------------------------
def rrf_fuse(
    knn: DataFrame,
    bm25: DataFrame,
    k: int,
    rrf_k: int = lx.RRF_K,
    w_knn: float = lx.RRF_WEIGHT_KNN,
    w_bm25: float = lx.RRF_WEIGHT_BM25,
) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists of ``query_id, chunk_id, clause_id, rank``.

    Every list entry adds its share, so several sub-blocks of one clause add
    up.  Equal scores keep the vector list first, then list order.  ``chunk_id``
    is the entry that brought the clause in.
    """

    def entries(hits: DataFrame, weight: float, source: int) -> DataFrame:
        return hits.select(
            "query_id", "clause_id", "chunk_id", F.lit(source).alias("source"), "rank",
            (F.lit(weight) / (F.lit(rrf_k) + F.col("rank"))).alias("share"),
        )

    fused = (
        entries(knn, w_knn, 0)
        .unionByName(entries(bm25, w_bm25, 1))
        .groupBy("query_id", "clause_id")
        .agg(
            F.round(F.sum("share"), 6).alias("score"),
            F.min(F.when(F.col("source") == 0, F.col("rank"))).alias("knn_rank"),
            F.min(F.when(F.col("source") == 1, F.col("rank"))).alias("bm25_rank"),
            F.min_by("chunk_id", F.struct("source", "rank")).alias("chunk_id"),
        )
    )
    late = F.lit(1_000_000_000)
    order = [
        F.desc("score"), F.coalesce("knn_rank", late), F.coalesce("bm25_rank", late), F.asc("clause_id"),
    ]
    return top_rows(fused, ["query_id"], order, k).select(
        "query_id", "clause_id", "chunk_id", "score", "rank", "knn_rank", "bm25_rank"
    )


def hybrid_search(queries: DataFrame, chunks: DataFrame | SearchIndex, k: int, knn_enabled: bool = True) -> DataFrame:
    """Fused retrieval: ``query_id, clause_id, chunk_id, score, rank, knn_rank, bm25_rank``.

    ``queries``: ``query_id, kb_id, text, vector``; ``chunks``: a chunk table, or its index when several searches share
    it.  Without vectors the lexical list is returned with its own scores.
    """
    index = chunks if isinstance(chunks, SearchIndex) else search_index(chunks, knn_enabled)
    lexical = bm25_hits(queries, index.lexical, k)
    if not knn_enabled:
        return lexical.select(
            "query_id", "clause_id", "chunk_id", "score", "rank",
            F.lit(None).cast("int").alias("knn_rank"), F.col("rank").alias("bm25_rank"),
        )
    return rrf_fuse(knn_hits(queries, index.vectors, k), lexical, k)


def with_contents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach the text of the chunk that brought each hit in; hits of checked size are broadcast, so that the chunk table
    is not shuffled."""
    hits = written(hits, "hits")
    return chunks.select("chunk_id", "content").join(broadcast_if_small(hits), "chunk_id")
