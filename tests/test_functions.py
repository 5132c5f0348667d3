"""Golden values of the column functions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from clauselake.functions import calc, json_text, numerals, params, rules
from clauselake.functions import lexicons as lx
from clauselake.operators import clauses


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v")).alias("out")).collect()]


def computed(spark, text, previous=None):
    c = F.col
    df = spark.createDataFrame([(text, previous)], "t string, prev string")
    df = df.select("*", *params.param_columns(c("t"))).withColumn("ct", calc.route_calc(c("t"), c("prev")))
    args = [c("ct"), c("principal"), c("rate_per_mille"), c("days"), c("force_majeure"), c("t")]
    df = df.withColumn("amount", calc.compute_amount(*args))
    return df.withColumn("handoff", calc.handoff_text(*args, c("amount"))).head()


@pytest.mark.parametrize(
    "text, principal, rate, days, amount",
    [
        ("100万逾期30天违约金多少", 1_000_000.0, 0.5, 30, 15000.0),
        ("货款5000元逾期两个月", 5000.0, 0.5, 60, 150.0),
        ("借款10万，利率5%，60天", 100_000.0, 50.0, 60, 2268.49),
        ("货款10万逾期10天，日千分之五", 100_000.0, 5.0, 10, 5000.0),
        ("定金20万，货款80万逾期半年，日利率千分之一", 200_000.0, 1.0, 180, 13610.96),
        ("欠款2万，没逾期", 20_000.0, 0.5, 0, 0.0),
        ("因不可抗力逾期10天，欠款2万", 20_000.0, 0.5, 10, 0.0),
        ("货款1亿逾期一个半月，万分之半", 1e8, 0.05, 45, 225000.0),
        ("这条条款是否有问题", None, None, None, None),
    ],
)
def test_extraction_and_amount(spark, text, principal, rate, days, amount):
    r = computed(spark, text)
    assert (r.principal, r.rate_per_mille, r.days, r.amount) == (principal, rate, days, amount)


def test_inherited_type_keeps_cap(spark):
    df = spark.createDataFrame([(100000.0, 50.0, 60), (100000.0, 50.0, 365)], "p double, r double, d int")
    out = [r[0] for r in df.select(calc.interest_amount(F.col("p"), F.col("r"), F.col("d"))).collect()]
    assert out == [2268.49, 13800.0]
    assert computed(spark, "改成60天呢", "LOAN_INTEREST").ct == "LOAN_INTEREST"
    assert computed(spark, "改成60天呢").ct == "PENALTY"


def test_handoff_texts(spark):
    assert computed(spark, "100万逾期30天违约金多少").handoff == (
        "[PENALTY] 本金1000000元，日利率0.5000‰，30天，金额=15000.00元（公式 1000000.0 × (0.5/1000) × 30）"
    )
    assert computed(spark, "100元30天").handoff == "（计算失败：参数不完整且 LLM 直算无结果）"
    assert computed(spark, "你好").handoff == "（非金额计算语境，无需计算）"


def test_numerals(spark):
    assert column(spark, ["五十", "十", "二十", "四十", "三十五", "35", "零五", "5十", "一百二十", ""], numerals.ratio_number) == [
        50.0, 10.0, 20.0, 40.0, 35.0, 35.0, None, None, 120.0, None,
    ]
    assert column(spark, ["十", "一百零三", "一千零二十", "12", "甲"], numerals.clause_ordinal) == [10, 103, 1020, 12, 0]
    amounts = ["0", "10", "1005.05", "10001", "100000000", "-20.50", None]
    expect = ["零元整", "壹拾元整", "壹仟零伍元零伍分", "壹万壹元整", "壹亿元整", "负贰拾元伍角", "零元整"]
    assert column(spark, amounts, lambda c: numerals.money_capitals(c.cast("decimal(18,2)"))) == expect


def test_penalty_ratio(spark):
    texts = ["违约金为百分之五十", "滞纳金百分之四十", "违约金为百分之十", "违约金为千分之一", "借款利率百分之五十"]
    assert column(spark, texts, lambda c: rules.penalty_ratio_anomaly(c).isNotNull()) == [True, True, False, False, False]


def test_triage_rules(spark):
    assert all(column(spark, lx.REVIEW_ANCHORS, rules.review_intent))
    assert column(spark, ["货款逾期怎么赔", None, "", "  "], rules.review_intent) == [False] * 4
    path = column(spark, ["审查股东协议", "起草协议", "货款", "那它呢", "那离婚呢"], lambda c: rules.scope_path(c, F.lit(True)))
    assert path == ["hard", "review", "anchor", "anaphora", "verdict"]
    assert column(spark, ["out_of_scope", "in_scope", "out_of_scope in_scope", None], rules.scope_verdict_rejects) == [
        True, False, False, False,
    ]


def test_verdict_readers(spark):
    raw = ['x {"维度":"数值","是否有风险":"是","风险描述":""} y', " ", "{bad"]
    got = column(spark, raw, json_text.judgement_struct)
    assert [(g.point, g.risky, g.risk_point) for g in got] == [
        ("NUMERIC", True, "（模型未给出风险描述）"), ("SEMANTIC", True, "（模型未返回结论）"), ("SEMANTIC", True, "（结论解析失败）"),
    ]
    assert column(spark, ["相关|0.85", "不相关|0.9", "相关 | 0.6", "?", None], rules.grade_score) == [0.85, 0.0, 0.6, 0.0, 0.0]
    assert column(spark, ["风险点：甲\n乙\n改写建议: 丙", "全文", ""], lambda c: json_text.extract_section(c, "风险点")) == [
        "甲\n乙", "全文", "（生成失败）",
    ]


def split(spark, text, label="doc99"):
    df = spark.createDataFrame([(1, text, label)], "id int, t string, l string")
    return clauses.split_clauses(df, ["id"], "t", "l").orderBy("chunk_index").collect()


def test_clause_blocks(spark):
    long = "第三条 " + "".join(f"（{n}）" + "甲方应当按约履行义务。" * 40 for n in "一二三")
    got = split(spark, "本合同由甲乙双方订立。\n第一条 总则。\n第二条 价款。\n" + long + "\n第四条 其他。")
    assert [g.chunk_id for g in got] == [
        "doc99-引言", "doc99-第1条", "doc99-第2条", "doc99-第3条#1", "doc99-第3条#2", "doc99-第3条#3", "doc99-第4条",
    ]
    assert got[3].content.startswith("（一）") and [g.chunk_index for g in got] == list(range(7))
    jumped = split(spark, "前言。第一条 甲。第二条 乙。第九条 丙。")
    assert [(g.canonical_id, g.content) for g in jumped] == [
        ("doc99-引言", "前言。"), ("doc99-第1条", "第一条 甲。"), ("doc99-第2条", "第二条 乙。第九条 丙。"),
    ]
    assert [g.canonical_id for g in split(spark, "没有条款结构的文本", " ")] == ["doc-全文"]
    assert split(spark, "  ") == []


def test_completeness(spark):
    cases = [
        ("第一条 甲乙双方协商一致。", 1, 0), ("甲方应按期交货，乙方应按期付款。", 2, 2), ("双方达成如下协议，共同遵守。", 0, 2),
        ("甲方与乙方就货物标的、数量、价款、交付时间、违约责任、争议解决等达成一致。", 4, 0), ("嗯", 0, 0), ("甲乙双方就合作事项达成协议。", 5, 2),
    ]
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(cases)], "i int, t string, n int")
    sizes = [r[0] for r in clauses.missing_elements(df, "t", "n").orderBy("i").select(F.size("missing")).collect()]
    assert all((s >= want if want else s == 0) for s, (_, _, want) in zip(sizes, cases))


def test_cents_follow_the_binary_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(2)
    values = [1.005, 0.125, 2.675, 1.115, 0.285, -1.005, 0.0, 1e12 + 0.125, 4.35, 1.0, 123456.785, 0.005]
    values += [round(rng.uniform(0, 1e5), 3) for _ in range(300)] + [rng.randrange(10**9) / 1000 + 0.005 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", calc.cents_half_up(F.col("v")).alias("half"), calc.cents_nearest(F.col("v")).alias("nearest")).collect()
    for r in rows:
        assert r.half == float(Decimal(r.v).quantize(Decimal("0.01"), ROUND_HALF_UP)), r
        assert r.nearest == math.floor(r.v * 100.0 + 0.5) / 100.0
    odd = spark.createDataFrame([(float("inf"),), (1e300,), (None,)], "v double")
    assert [r[0] for r in odd.select(calc.cents_half_up(F.col("v"))).collect()] == [None, 1e300, None]


def test_huge_numbers_give_null_or_a_value_never_an_error(spark):
    texts = ["逾期99999999个月", "逾期99999999年", "货款" + "9" * 40 + "元逾期3天违约金万分之五", "本金" + "9" * 400 + "元", "9" * 400 + "万"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = df.select(params.principal(t).alias("p"), params.overdue_days(t).alias("d"), params.daily_rate(t).alias("r"), "t")
    rows = rows.withColumn("a", calc.penalty_amount(F.col("p"), F.col("r"), F.col("d"), t)).collect()
    assert [r.d for r in rows] == [None, None, 3, None, None]
    assert rows[2].p == float("9" * 40) and rows[2].a > 1e35
    call = '{"tool": "calculate", "arguments": {"principal": 1, "days": 1e12}}'
    assert spark.createDataFrame([(call,)], "c string").select(json_text.tool_call(F.col("c"))["days"]).head()[0] == 0


def test_first_amount_of_many(spark):
    rng = random.Random(3)
    parts = [f"条款{i}约定{rng.choice(['价款', '违约金', '押金', '本金', '其他', ''])}{i + 1}{rng.choice(['元', '万', '万元', '亿'])}，" for i in range(300)]
    df = spark.createDataFrame([("".join(parts[:n]),) for n in (0, 1, 2, 5, 40, 300)], "t string")
    got = [r[0] for r in df.select(params.principal(F.col("t"))).collect()]
    want = [plain_principal("".join(parts[:n])) for n in (0, 1, 2, 5, 40, 300)]
    assert got == want


def plain_principal(text):
    from clauselake.functions import lexicons as lx

    best = []
    for order, pattern in ((0, params.WAN_YI), (1, params.YUAN)):
        for i, m in enumerate(re.finditer(pattern, text)):
            context = text[max(0, m.start() - lx.CONTEXT_WINDOW) : m.end() + lx.CONTEXT_WINDOW]
            rank = 2 if any(w in context for w in lx.EXCLUDED_CONTEXT) else 0 if any(w in context for w in lx.PRINCIPAL_CONTEXT) else 1
            unit = 1.0 if order else 1e8 if m.group().endswith("亿") else 1e4
            best.append((rank, order, i, float(m.group(1)) * unit))
    return min(best)[3] if best else None


def test_repeated_section_titles(spark):
    rows = [("风险点：甲\n风险点：丙\n改写建议：乙", "甲\n丙"), ("风险点：甲\n改写建议：乙\n风险点：丙", "甲"), ("改写建议：乙", "改写建议：乙")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r[0] == r[1] for r in df.select(json_text.extract_section(F.col("raw"), "风险点"), "want").collect())


def test_a_calculator_can_be_added(spark):
    calc.register("FLAT", lambda p, r, d, t: p * 0 + 7.0, lambda p, r, d, t: F.lit("flat"))
    try:
        c = F.col
        df = spark.createDataFrame([("FLAT", 10.0, 0.5, 3, "x"), ("PENALTY", 10000.0, 0.5, 3, "x")], "k string, p double, r double, d int, t string")
        args = [c("k"), c("p"), c("r"), c("d"), F.lit(False), c("t")]
        rows = df.withColumn("a", calc.compute_amount(*args)).withColumn("h", calc.handoff_text(*args, c("a"))).collect()
        assert [r.a for r in rows] == [7.0, 15.0] and "公式 flat" in rows[0].h
    finally:
        del calc.CALCULATORS["FLAT"]
