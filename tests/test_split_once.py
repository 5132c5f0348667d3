"""Texts are split once, and a split reads each piece once."""

import pytest
from pyspark.sql import functions as F

from clauselake.functions import text as tx
from clauselake.operators import review, verdicts
from clauselake.plans import registry
from clauselake.sources.tables import schema_of

HEADING = "条(?="


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    orders = [(i, i % 3, "O", 1000.0 + i, None, "1-URGENT") for i in range(20)]
    lines = [(i, 30 * i, 1, i % 4 + 1, 1.0, 1.0, 0.0, 0.0, "N", "O", None) for i in range(8)]
    for name, rows in (("orders", orders), ("lineitem", lines)):
        spark.createDataFrame(rows, schema_of(name)).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_long_clauses_are_not_cut_a_second_time_in_a_filter(spark, folder):
    found = registry.QUERIES["split_long"](spark, folder)
    assert _plan(found).count("split(") == 2  # at marks, or at sentence ends
    assert {r.l_orderkey for r in found.collect()} == set(range(8))


def test_verdicts_read_texts_that_were_split_before(spark, folder):
    cache, missing = (registry.QUERIES[q](spark, folder) for q in ("verdict_cache", "verdict_missing"))
    assert HEADING not in _plan(cache) and HEADING not in _plan(missing)
    kept = {r.text_hash for r in cache.filter("NOT cached").collect()}
    assert {r.text_hash for r in missing.collect()} == kept


def test_a_review_splits_its_contracts_once(spark):
    contracts = spark.createDataFrame([(1, "d", "第1条 甲方付款。第2条 乙方交货。"), (2, "e", None), (1, "d", "第1条 甲方付款。")], "contract_id long, label string, text string")
    statutes = spark.createDataFrame([("c", "1", None, "甲方付款", [1.0])], "chunk_id string, kb_id string, canonical_id string, content string, vector array<float>")
    none = spark.createDataFrame([], "text_hash string, raw string")
    items = review.review_contracts(contracts, statutes, none)
    assert HEADING not in _plan(items)
    assert sorted((r.contract_id, r.pos) for r in items.filter("clause_label LIKE '第%'").collect()) == [(1, 0), (1, 0), (1, 1)]


def test_missing_texts_are_not_sorted(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "content string")
    none = spark.createDataFrame([], "text_hash string, raw string, verdict_sec long")
    found = verdicts.missing_texts(rows, none, "content", F.lit(0))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.content or "" for r in found.collect()) == ["", "a", "b"]


def test_numbers_of_headings(spark):
    row = spark.createDataFrame([(["前言", "第十二条 甲", "第 3 条", ""],)], "p array<string>")
    assert row.select(tx.heading_numbers(F.col("p")).alias("n")).first().n == [None, 12, 3, None]
