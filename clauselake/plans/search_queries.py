"""Queries over retrieval, grading and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.operators import answer, evaluate, search
from clauselake.operators.clauses import resolve_clause_id as resolve
from clauselake.plans import inputs, oracle
from clauselake.runtime import cut_lineage, scratch_path
from clauselake.sources import records
from clauselake.sources.tables import read_table

K = 10


def _asked_queries(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.asked(spark, sf).selectExpr("CAST(question_id AS STRING) AS query_id", "kb_id", "text", "vector")


_ASKED_Q = f"SELECT CAST(question_id AS VARCHAR) AS query_id, kb_id, text, vector FROM ({inputs.ASKED_SQL})"


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25_topk(inputs.bench_queries(spark, sf), inputs.doc_chunks(spark, sf), K)


def _label_queries(spark: SparkSession, sf: str) -> DataFrame:
    vectors = inputs.VECTORS.frame(spark, sf)
    items = read_table(spark, sf, "benchmark").select("item_id")
    return vectors.join(items, vectors["vec_id"] == items["item_id"]).selectExpr(
        "CONCAT('q', CAST(vec_id AS STRING)) AS query_id", "CAST(label AS STRING) AS kb_id", "vector"
    )


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    chunks = inputs.VECTORS.frame(spark, sf).selectExpr(
        "CONCAT('v', CAST(vec_id AS STRING)) AS chunk_id", "CAST(label AS STRING) AS kb_id", "vector"
    )
    return search.knn_topk(_label_queries(spark, sf), chunks, K)


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return search.hybrid_search(_asked_queries(spark, sf), inputs.statutes(spark, sf), K)


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.hybrid_search(inputs.bench_queries(spark, sf), inputs.doc_chunks(spark, sf), K)


def lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval without vectors: the lexical list with its own scores."""
    queries, chunks = _asked_queries(spark, sf), inputs.statutes(spark, sf)
    return search.hybrid_search(queries, chunks, K, knn_enabled=False).select("query_id", "clause_id", "chunk_id", "score", "rank")


def resolve_clause_id(spark: SparkSession, sf: str) -> DataFrame:
    chunks = inputs.statutes(spark, sf)
    return chunks.select("chunk_id", resolve(F.col("canonical_id"), F.col("chunk_id")).alias("clause_id"))


def cite_clause(spark: SparkSession, sf: str) -> DataFrame:
    chunks = inputs.statutes(spark, sf)
    queries = _asked_queries(spark, sf)
    hits = search.hybrid_search(queries, chunks, lx.CITE_TOP_K)
    return search.with_contents(hits, chunks).select("query_id", "rank", F.col("content").alias("text"))


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, their hits, and the clauses that hold the whole query."""
    queries, chunks = inputs.bench_queries(spark, sf), inputs.doc_chunks(spark, sf)
    hits = search.with_contents(search.hybrid_search(queries, chunks, K), chunks)
    texts = hits.join(queries.select("query_id", "text"), "query_id")
    gold = texts.filter(F.col("content").contains(F.col("text"))).select("query_id", "clause_id").distinct()
    return queries, hits, gold


def eval_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.retrieval_rates(*_judged(spark, sf))


def eval_retrieval_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.retrieval_intervals(*_judged(spark, sf))


_RAW = (
    "CASE WHEN v % 151 = question_id % 151 THEN CONCAT('判断：相关 | 0.', CAST(4 + v % 6 AS STRING)) "
    "WHEN v % 3 = 0 THEN CONCAT('不相关|0.', CAST(5 + v % 5 AS STRING)) WHEN v % 3 = 1 THEN '相关|0.3' ELSE '无法判断' END"
)


def grader(hits: DataFrame) -> DataFrame:
    """Stands in for the relevance model: a verdict text from question and clause."""
    numbered = hits.withColumn("v", F.regexp_extract("content", "第([0-9]+)款", 1).cast("bigint"))
    return numbered.withColumn("raw", F.expr(_RAW)).drop("v")


def grade_gate(spark: SparkSession, sf: str) -> DataFrame:
    chunks = inputs.statutes(spark, sf)
    queries = _asked_queries(spark, sf)
    hits = search.with_contents(search.hybrid_search(queries, chunks, K), chunks)
    asked = hits.withColumn("question_id", F.col("query_id").cast("bigint"))
    return answer.grade_hits(grader(asked)).select("question_id", "clause_id", "rank", "grade", "kept")


REWRITES = {
    "question_id": "question_id",
    "conv_id": "conv_id",
    "round": "r",
    "text": "CASE WHEN question_id % 3 = 0 AND r = 2 THEN ' ' WHEN r = 1 THEN CONCAT(text, ' 违约金 减少') ELSE CONCAT(text, ' 约定的期限 标的物') END",
}


def rewrites(spark: SparkSession, sf: str) -> DataFrame:
    vectors = inputs.VECTORS.frame(spark, sf).select("vec_id", "vector")
    rows = inputs.ASKED.frame(spark, sf).withColumn("r", F.explode(F.array(F.lit(1), F.lit(2))))
    worded = rows.selectExpr(*[f"{e} AS {n}" for n, e in REWRITES.items()])
    return worded.join(vectors, worded["conv_id"] + worded["round"] == vectors["vec_id"], "left").drop("vec_id", "conv_id")


_REWRITES_SQL = (
    "SELECT w.question_id, w.round, w.text, v.vector FROM (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in REWRITES.items())
    + f" FROM ({inputs.ASKED.sql()}), (VALUES (1), (2)) rr(r)) w LEFT JOIN ({inputs.VECTORS.sql()}) v ON v.vec_id = w.conv_id + w.round"
)


def gated(spark: SparkSession, sf: str) -> DataFrame:
    return answer.gated_retrieval(inputs.asked(spark, sf), inputs.statutes(spark, sf), grader, rewrites(spark, sf))


def retrieval_rounds(spark: SparkSession, sf: str) -> DataFrame:
    asked = inputs.asked(spark, sf).select("question_id")
    rounds = answer.round_contexts(asked, gated(spark, sf))
    return rounds.select("question_id", "rounds_used", "kept_hits", "passages", F.sha2("context", 256).alias("context_digest"), "refusal")


def gated_ctes(prefix: str = "") -> list[tuple[str, str]]:
    """CTEs ending in ``gated(question_id, round, clause_id, rank, content, kept, used)``."""
    ctes = [
        ("statutes", inputs.STATUTES.sql()),
        ("aq", inputs.ASKED_SQL),
        ("rw", _REWRITES_SQL),
        ("cur0", "SELECT question_id AS query_id, kb_id, text, vector FROM aq"),
    ]
    for r in range(3):
        ctes += oracle.hybrid_ctes(f"cur{r}", "statutes", lx.RECALL_SIZE, f"r{r}_")
        grade = (
            r"CASE WHEN regexp_matches(raw, '不相关') THEN 0.0 ELSE coalesce(TRY_CAST(nullif(regexp_extract(raw, '相关\s*\|\s*([0-9.]+)', 1), '') AS DOUBLE), 0) END"
        )
        ctes += [
            (f"g{r}", f"SELECT *, {grade} >= 0.6 AS kept FROM (SELECT *, {_RAW} AS raw FROM (SELECT f.query_id AS question_id, {r} AS round, f.clause_id, f.chunk_id, f.score, f.rank, content, "
                      f"CAST(regexp_extract(content, '第([0-9]+)款', 1) AS BIGINT) AS v FROM r{r}_fused f JOIN statutes USING (chunk_id)))"),
            (f"res{r}", f"SELECT DISTINCT question_id FROM g{r} WHERE kept"),
        ]
        if r < 2:
            ctes.append(
                (f"cur{r + 1}", f"SELECT c.query_id, c.kb_id, CASE WHEN trim(coalesce(w.text, '')) <> '' THEN w.text ELSE c.text END AS text, CASE WHEN trim(coalesce(w.text, '')) <> '' THEN w.vector ELSE c.vector END AS vector "
                                f"FROM cur{r} c LEFT JOIN rw w ON w.question_id = c.query_id AND w.round = {r + 1} WHERE c.query_id NOT IN (SELECT question_id FROM res{r})")
            )
    ctes += [
        ("settled", "SELECT * FROM g0 WHERE question_id IN (FROM res0) UNION ALL SELECT * FROM g1 WHERE question_id IN (FROM res1) UNION ALL SELECT * FROM g2"),
        ("gated", "SELECT *, kept OR NOT bool_or(kept) OVER (PARTITION BY question_id) AS used FROM settled"),
    ]
    return ctes


def single_round_context(spark: SparkSession, sf: str) -> DataFrame:
    return answer.single_round_context(inputs.asked(spark, sf), inputs.statutes(spark, sf)).select(
        "question_id", "session_id", "context", "passages", "refusal"
    )


_SINGLE_PROSE = "CASE WHEN question_id % 7 <> 3 THEN CONCAT('依据[1]答复', CAST(question_id AS STRING)) END"


def single_round_history(spark: SparkSession, sf: str) -> DataFrame:
    """The history after two batches of single-round answers, of which the second holds some questions of the first."""
    path = scratch_path(spark, "single-rounds")
    questions, chunks = inputs.asked(spark, sf), inputs.statutes(spark, sf)
    found = cut_lineage(answer.single_round_context(questions, chunks))
    for part in ("question_id % 3 <> 0", "question_id % 2 = 0 OR question_id % 3 = 0"):
        batch = found.filter(part)
        rounds = answer.answered_rounds(batch, batch.selectExpr("question_id", f"{_SINGLE_PROSE} AS prose"))
        records.append_new_rounds(rounds, path)
    return spark.read.parquet(path).select("session_id", "id", "question", "answer", "passages")


_HITS = "query_id, clause_id, chunk_id, score, rank, knn_rank, bm25_rank"
_BENCH = [("queries", inputs.BENCH_QUERIES_SQL), ("chunks", inputs.DOC_CHUNKS_SQL)]
_STAT = [("queries", _ASKED_Q), ("chunks", inputs.STATUTES.sql())]

QUERIES = {
    "hybrid_search": hybrid_search,
    "bm25_topk": bm25_topk,
    "knn_topk": knn_topk,
    "rrf_fuse": rrf_fuse,
    "lexical_search": lexical_search,
    "resolve_clause_id": resolve_clause_id,
    "cite_clause": cite_clause,
    "eval_retrieval": eval_retrieval,
    "eval_retrieval_intervals": eval_retrieval_intervals,
    "grade_gate": grade_gate,
    "retrieval_rounds": retrieval_rounds,
    "single_round_context": single_round_context,
    "single_round_history": single_round_history,
}

ORACLES = {
    "hybrid_search": oracle.with_(*_BENCH, *oracle.hybrid_ctes("queries", "chunks", K)) + f"SELECT {_HITS} FROM fused",
    "bm25_topk": oracle.with_(*_BENCH, *oracle.bm25_ctes("queries", "chunks", K)) + "SELECT * FROM bm25",
    "knn_topk": oracle.with_(
        ("chunks", "SELECT 'v' || vec_id AS chunk_id, CAST(label AS VARCHAR) AS kb_id, embedding AS vector FROM embeddings"),
        ("queries", "SELECT 'q' || vec_id AS query_id, CAST(label AS VARCHAR) AS kb_id, embedding AS vector FROM embeddings JOIN benchmark ON vec_id = item_id"),
        *oracle.knn_ctes("queries", "chunks", K),
    )
    + "SELECT * FROM knn",
    "rrf_fuse": oracle.with_(*_STAT, *oracle.hybrid_ctes("queries", "chunks", K)) + f"SELECT {_HITS} FROM fused",
    "lexical_search": oracle.with_(*_STAT, *oracle.bm25_ctes("queries", "chunks", K))
    + "SELECT query_id, coalesce(canonical_id, b.chunk_id) AS clause_id, b.chunk_id, score, rank FROM bm25 b JOIN chunks USING (chunk_id)",
    "resolve_clause_id": f"SELECT chunk_id, coalesce(canonical_id, chunk_id) AS clause_id FROM ({inputs.STATUTES.sql()})",
    "cite_clause": oracle.with_(*_STAT, *oracle.hybrid_ctes("queries", "chunks", lx.CITE_TOP_K))
    + "SELECT query_id, rank, content AS text FROM fused JOIN chunks USING (chunk_id)",
    "eval_retrieval": oracle.with_(*_BENCH, *oracle.hybrid_ctes("queries", "chunks", K),
        ("best", "SELECT query_id, min(f.rank) AS best FROM fused f JOIN chunks USING (chunk_id) JOIN queries q USING (query_id) WHERE contains(content, q.text) GROUP BY query_id"))
    + "SELECT count(*) AS queries, " + ", ".join(f"round(avg(CASE WHEN best <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hr_at_{k}" for k in (1, 3, 5))
    + ", round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr FROM queries LEFT JOIN best USING (query_id)",
    "eval_retrieval_intervals": oracle.with_(*_BENCH, *oracle.hybrid_ctes("queries", "chunks", K),
        ("best", "SELECT query_id, min(f.rank) AS best FROM fused f JOIN chunks USING (chunk_id) JOIN queries q USING (query_id) WHERE contains(content, q.text) GROUP BY query_id"),
        ("cases", "SELECT query_id AS case_id, coalesce(CAST(best <= 1 AS DOUBLE), 0) AS n0, coalesce(CAST(best <= 3 AS DOUBLE), 0) AS n1, coalesce(CAST(best <= 5 AS DOUBLE), 0) AS n2, coalesce(1.0::DOUBLE / best, 0) AS n3, 1.0::DOUBLE AS d FROM queries LEFT JOIN best USING (query_id)"),
        *oracle.bootstrap_ctes("cases", {"hr_at_1": ("n0", "d"), "hr_at_3": ("n1", "d"), "hr_at_5": ("n2", "d"), "mrr": ("n3", "d")}))
    + "SELECT * FROM intervals",
    "grade_gate": oracle.with_(*_STAT, *oracle.hybrid_ctes("queries", "chunks", K),
        ("h", f"SELECT *, {_RAW} AS raw FROM (SELECT CAST(query_id AS BIGINT) AS question_id, clause_id, rank, content, CAST(regexp_extract(content, '第([0-9]+)款', 1) AS BIGINT) AS v FROM fused JOIN chunks USING (chunk_id))"),
        ("g", r"SELECT *, CASE WHEN contains(raw, '不相关') THEN 0.0::DOUBLE ELSE coalesce(TRY_CAST(nullif(regexp_extract(raw, '相关\s*\|\s*([0-9.]+)', 1), '') AS DOUBLE), 0) END AS grade FROM h"))
    + "SELECT question_id, clause_id, rank, grade, grade >= 0.6 AS kept FROM g",
    "retrieval_rounds": oracle.with_(*gated_ctes(),
        ("num", "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i FROM gated WHERE used"),
        ("ctx", "SELECT question_id, CAST(count(*) AS INT) AS passages, sha256(string_agg('[' || i || '] ' || content || chr(10) || chr(10), '' ORDER BY i)) AS context_digest FROM num GROUP BY question_id"),
        ("rnd", "SELECT question_id, max(round) AS rounds_used, count(*) FILTER (kept) AS kept_hits FROM gated GROUP BY question_id"))
    + f"SELECT question_id, coalesce(rounds_used, {lx.MAX_REWRITES}) AS rounds_used, coalesce(kept_hits, 0) AS kept_hits, coalesce(passages, 0) AS passages, context_digest, "
    f"CASE WHEN context_digest IS NULL THEN '{lx.REJECT_ANSWER}' END AS refusal FROM aq LEFT JOIN rnd USING (question_id) LEFT JOIN ctx USING (question_id)",
    "single_round_context": oracle.with_(("aq", inputs.ASKED_SQL), *_STAT, *oracle.hybrid_ctes("queries", "chunks", lx.SINGLE_ROUND_TOP_K),
        ("ctx", "SELECT CAST(query_id AS BIGINT) AS question_id, string_agg('[' || f.rank || '] ' || content || chr(10), '' ORDER BY f.rank) AS context, CAST(count(*) AS INT) AS passages FROM fused f JOIN chunks USING (chunk_id) GROUP BY query_id"))
    + f"SELECT question_id, session_id, context, passages, CASE WHEN context IS NULL THEN '{lx.SINGLE_ROUND_REJECT}' END AS refusal FROM aq LEFT JOIN ctx USING (question_id)",
    "single_round_history": oracle.with_(("aq", inputs.ASKED_SQL), *_STAT, *oracle.hybrid_ctes("queries", "chunks", lx.SINGLE_ROUND_TOP_K),
        ("n", "SELECT CAST(query_id AS BIGINT) AS question_id, CAST(count(*) AS INT) AS passages FROM fused GROUP BY query_id"))
    + f"SELECT session_id, question_id AS id, text AS question, {_SINGLE_PROSE} AS answer, passages FROM aq JOIN n USING (question_id) WHERE question_id % 7 <> 3",
}
