"""Queries in SQL text over the registered SQL functions; the oracles are those of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauselake.functions import lexicons as lx
from clauselake.functions import sql_functions
from clauselake.operators import search
from clauselake.plans import inputs, oracle, review_queries, search_queries
from clauselake.plans.calc_queries import _PARAMS, extracted


def sql_calculate_penalty(spark: SparkSession, sf: str) -> DataFrame:
    sql_functions.register(spark)
    return spark.sql(
        "SELECT a.question_id, round(p.rate, 6) AS rate, p.error, p.penalty "
        "FROM {asked} a, LATERAL calculate_penalty(a.principal, a.rate_per_mille, a.days, a.text) p",
        asked=extracted(spark, sf),
    )


def sql_clause_blocks(spark: SparkSession, sf: str) -> DataFrame:
    sql_functions.register(spark)
    return spark.sql(
        "SELECT contract_id, chunk_index, b.canonical_id, b.sub_index, b.chunk_id, b.content "
        "FROM (SELECT contract_id, clause_blocks(text, label) AS blocks FROM {contracts}) "
        "LATERAL VIEW OUTER posexplode(blocks) AS chunk_index, b WHERE chunk_index IS NOT NULL",
        contracts=inputs.CONTRACTS.frame(spark, sf),
    )


def sql_cite_clause(spark: SparkSession, sf: str) -> DataFrame:
    chunks, queries = inputs.statutes(spark, sf), inputs.asked(spark, sf).selectExpr(
        "CAST(question_id AS STRING) AS query_id", "kb_id", "text", "vector"
    )
    sql_functions.citations(search.with_contents(search.hybrid_search(queries, chunks, lx.CITE_TOP_K), chunks))
    return spark.sql(
        "SELECT q.query_id, c.rank, c.text FROM {queries} q, LATERAL cite_clause(q.query_id, {k}) c", queries=queries, k=lx.CITE_TOP_K
    )


_ERROR = (
    "array_to_string(list_filter([CASE WHEN NOT principal > 0 THEN 'principal 必须为正数' END, "
    "CASE WHEN NOT rate > 0 THEN 'daily_rate_per_mille 必须为正数' WHEN rate > 100 THEN 'daily_rate_per_mille 超出合理范围(<= 100.0)' END, "
    "CASE WHEN NOT days > 0 THEN 'days 必须为正整数' END], lambda x: x IS NOT NULL), '; ')"
)

QUERIES = {
    "sql_calculate_penalty": sql_calculate_penalty,
    "sql_clause_blocks": sql_clause_blocks,
    "sql_cite_clause": sql_cite_clause,
}

ORACLES = {
    "sql_calculate_penalty": oracle.with_(
        *_PARAMS,
        ("rated", f"SELECT *, {oracle.normalized_rate('rate_per_mille', 'text')} AS rate FROM params"),
        ("checked", f"SELECT *, {_ERROR} AS error FROM rated"),
    )
    + "SELECT question_id, round(rate, 6) AS rate, error, "
    + f"CASE WHEN error = '' THEN {oracle.penalty('principal', 'rate_per_mille', 'days', 'text')} END AS penalty FROM checked",
    "sql_clause_blocks": review_queries.ORACLES["split_clauses"],
    "sql_cite_clause": search_queries.ORACLES["cite_clause"],
}
