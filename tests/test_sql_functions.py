"""SQL functions against the column functions of the same names."""

import pytest
from pyspark.sql import functions as F

from clauselake.functions import calc, sql_functions
from clauselake.operators.clauses import split_clauses

TEXTS = [
    (None, "a"), ("", "b"), (" \n ", "c"), ("没有条款的文本", None), ("没有条款的文本", "  "),
    ("引言。\n第一条 甲方\n第二条：乙方\n第九条 跳号\n第三条 丙", "合同"),
    ("第3条 a\n第十二条 b\n第一百零五条 c\n第千条 d", "数字"), ("第一条款 不是标题 第 二 条 是", "空格"),
    ("第一条 " + "甲方应付款；乙方应交货。" * 90 + "\n第二条 短", "长"),
    ("第一条 总则（一）" + "甲" * 500 + "（二）" + "乙" * 500, "款"), ("第一条 " + "丙" * 1900, "无标点"),
    ("第一条 x\n第99999999999条 y", "大数"), ("A" * 2000, "长文"),
]
CALLS = [
    (10000.0, 0.5, 30, "日利率"), (10000.0, 5.0, 30, None), (10000.0, 15.0, 30, ""), (10000.0, 5.0, 30, "每日万分之五"),
    (10000.0, 50.0, 30, "千分之半"), (10000.0, 5.0, 30, "日利率0.05%"), (-1.0, 0.5, 30, ""), (1.0, -2.0, 0, ""), (1.0, 101.0, 3, ""),
    (None, 0.5, 30, ""), (1.0, None, 30, ""), (1.0, 0.5, None, ""), (1.005, 1.0, 1000, ""), (0.335, 1.0, 100, ""), (1e15, 1.0, 1000, ""),
    (float("inf"), 1.0, 1, ""), (float("nan"), 1.0, 1, ""),
]


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    sql_functions.register(spark)


def test_clause_blocks(spark):
    docs = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(TEXTS)], "id int, text string, label string")
    got = spark.sql(
        "SELECT id, chunk_index, b.* FROM (SELECT id, clause_blocks(text, label) AS blocks FROM {docs}) "
        "LATERAL VIEW OUTER posexplode(blocks) AS chunk_index, b WHERE chunk_index IS NOT NULL",
        docs=docs,
    )
    expect = split_clauses(docs, ["id"], "text", "label").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expect.collect()))
    assert got.count() > len(TEXTS)


def test_calculate_penalty(spark):
    calls = spark.createDataFrame([(i, *c) for i, c in enumerate(CALLS)], "id int, p double, r double, d int, context string")
    got = spark.sql("SELECT id, x.* FROM {calls} c, LATERAL calculate_penalty(c.p, c.r, c.d, c.context) x", calls=calls)
    c = F.col
    rate = calc.normalize_rate(c("r"), c("context"))
    error = calc.calc_argument_errors(c("p"), rate, c("d"))
    penalty = F.when(error == "", calc.penalty_amount(c("p"), c("r"), c("d"), c("context")))
    expect = calls.select("id", rate.alias("rate"), error.alias("error"), penalty.alias("penalty"))
    assert {r.id: repr(tuple(r)) for r in got.collect()} == {r.id: repr(tuple(r)) for r in expect.collect()}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_cite_clause(spark):
    hits = [("q1", 1, "x"), ("q1", 2, "y"), ("q1", 3, "z"), ("q2", 1, "w"), (None, 1, "v")]
    sql_functions.citations(spark.createDataFrame(hits, "query_id string, rank int, content string"))
    asked = spark.createDataFrame([("q1", 2), ("q2", 5), ("q3", 1), (None, 1), ("q1", 1)], "id string, k int")
    got = spark.sql("SELECT a.id, a.k, c.rank, c.text FROM {asked} a, LATERAL cite_clause(a.id, a.k) c", asked=asked).collect()
    assert sorted(map(tuple, got)) == [("q1", 1, 1, "x"), ("q1", 2, 1, "x"), ("q1", 2, 2, "y"), ("q2", 5, 1, "w")]
