"""Queries over numeric extraction and calculation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions import calc, json_text, numerals, params, rules
from clauselake.functions import lexicons as lx
from clauselake.plans import inputs, oracle
from clauselake.sources.tables import read_table

_TEXT = F.col


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    questions = inputs.QUESTIONS.frame(spark, sf)
    return questions.select("question_id", "text", *params.param_columns(F.col("text")))


def extract_params(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(spark, sf).drop("text")


def compute_amount(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    typed = extracted(spark, sf).withColumn("calc_type", calc.route_calc(c("text"), F.lit(None).cast("string")))
    args = [c("calc_type"), c("principal"), c("rate_per_mille"), c("days"), c("force_majeure"), c("text")]
    amounts = typed.withColumn("amount", calc.compute_amount(*args))
    handoff = calc.handoff_text(*args, c("amount"))
    return amounts.select(
        "question_id", "calc_type", "amount",
        handoff.alias("handoff"),
    )


def _formula_sql() -> str:
    r = "rate_per_mille"
    annual = f"({r} / 1000.0::DOUBLE * 365.0::DOUBLE)"
    loan = (
        f"'本金' || format('{{:.0f}}', principal) || ' × 年化' || format('{{:.4f}}', least({annual}, 0.138::DOUBLE) * 100.0::DOUBLE) || '% × ' || days || "
        f"'/365（封顶 13.8%，原始年化 ' || format('{{:.2f}}', {annual} * 100.0::DOUBLE) || '%）'"
    )
    plain = f"{oracle.java_double('principal')} || ' × (' || {oracle.java_double(oracle.normalized_rate(r, 'text'))} || '/1000) × ' || days"
    return f"CASE WHEN calc_type = 'LOAN_INTEREST' THEN {loan} ELSE {plain} END"


def _handoff_sql() -> str:
    r = "rate_per_mille"
    rate = (
        f"CASE WHEN {r} >= 100 THEN format('{{:.1f}}', {r}) WHEN {r} >= 10 THEN format('{{:.2f}}', {r}) "
        f"WHEN {r} >= 1 THEN format('{{:.3f}}', {r}) WHEN {r} = 0 THEN '0.000' ELSE format('{{:.4f}}', {r}) END"
    )
    return (
        "CASE WHEN force_majeure THEN '不可抗力免责（KB C3）：违约金=0元（问题：' || text || '）' WHEN amount IS NOT NULL THEN "
        f"'[' || calc_type || '] 本金' || format('{{:.0f}}', principal) || '元，日利率' || {rate} || '‰，' || days || "
        f"'天，金额=' || format('{{:.2f}}', amount) || '元（公式 ' || {_formula_sql()} || '）' "
        "WHEN principal > 0 AND days > 0 THEN '（计算失败：参数不完整且 LLM 直算无结果）' ELSE '（非金额计算语境，无需计算）' END"
    )


_PARAMS = [("questions", inputs.QUESTIONS.sql()), *oracle.params_ctes("questions", "question_id")]
_TYPED = f"SELECT *, coalesce({oracle.explicit_type('text')}, 'PENALTY') AS calc_type FROM params"
_ARGS = ("principal", "rate_per_mille", "days")


def penalty(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    p = extracted(spark, sf)
    rate = calc.normalize_rate(c("rate_per_mille"), c("text"))
    return p.select(
        "question_id", F.round(rate, 6).alias("rate"),
        calc.penalty_amount(c("principal"), c("rate_per_mille"), c("days"), c("text")).alias("penalty"),
    )


def loan_interest(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    args = (c("principal"), c("rate_per_mille"), c("days"))
    return extracted(spark, sf).select(
        "question_id",
        calc.interest_amount(*args).alias("simple"),
        calc.interest_amount(*args, compound=True).alias("compound"),
    )


def calc_route(spark: SparkSession, sf: str) -> DataFrame:
    from clauselake.operators.session import route_turns

    return route_turns(inputs.ASKED.frame(spark, sf)).select("question_id", "explicit_type", "calc_type")


def cn_number(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_NUMERAL} AS numeral").distinct()
    return li.select("*", numerals.ratio_number(F.col("numeral")).alias("value"))


_DIGIT = "substring('一二三四五六七八九', CAST({} AS INT), 1)"
_TENS = "CAST(FLOOR(l_partkey / 10) AS BIGINT) % 10"
_NUMERAL = (
    "CASE l_linenumber "
    f"WHEN 1 THEN {_DIGIT.format('l_partkey % 9 + 1')} "
    f"WHEN 2 THEN CONCAT({_DIGIT.format('l_partkey % 9 + 1')}, '十', {_DIGIT.format('l_suppkey % 9 + 1')}) "
    f"WHEN 3 THEN CONCAT('十', {_DIGIT.format('l_partkey % 9 + 1')}) "
    f"WHEN 4 THEN CONCAT({_DIGIT.format('l_partkey % 9 + 1')}, '百', {_DIGIT.format('l_suppkey % 9 + 1')}, '十') "
    "WHEN 5 THEN CAST(l_partkey % 100 AS STRING) "
    f"WHEN 6 THEN CONCAT('百零', {_DIGIT.format('l_partkey % 9 + 1')}) "
    f"ELSE CONCAT({_DIGIT.format('l_partkey % 9 + 1')}, '百', {_DIGIT.format('l_suppkey % 9 + 1')}) END"
)


def _place(unit: str) -> str:
    digit = f"regexp_extract(numeral, '([一二三四五六七八九]?){unit}', 1)"
    return f"CASE WHEN contains(numeral, '{unit}') THEN greatest(coalesce(strpos('一二三四五六七八九', nullif({digit}, '')), 1), 1) ELSE 0 END"


_CN_SQL = (
    "CASE WHEN contains(numeral, '零') THEN NULL WHEN regexp_matches(numeral, '^[0-9]+$') THEN CAST(numeral AS DOUBLE) ELSE "
    f"CAST({_place('百')} * 100 + {_place('十')} * 10 + coalesce(strpos('一二三四五六七八九', nullif(regexp_extract(numeral, '([一二三四五六七八九])$', 1), '')), 0) AS DOUBLE) END"
)


def penalty_ratio(spark: SparkSession, sf: str) -> DataFrame:
    contracts = inputs.CONTRACTS.frame(spark, sf)
    return contracts.select(
        "contract_id", F.round(rules.penalty_ratio_anomaly(F.col("text")), 6).alias("ratio")
    ).filter("ratio IS NOT NULL")


def validate_calc(spark: SparkSession, sf: str) -> DataFrame:
    calls = read_table(spark, sf, "orders").selectExpr(
        "o_custkey AS dialog", "o_orderkey AS seq", f"{_TOOL_RAW} AS raw", "'日利率' AS context"
    )
    call = json_text.tool_call(F.col("raw"))
    first = (
        calls.select("dialog", "seq", "context", call.alias("call"))
        .filter("call.tool = 'calculate_penalty'")
        .groupBy("dialog")
        .agg(F.min_by(F.struct("seq", "call", "context"), "seq").alias("f"))
        .select("dialog", "f.seq", "f.context", "f.call.*")
    )
    rate = calc.normalize_rate(F.col("rate_per_mille"), F.col("context"))
    checked = first.withColumn("rate", rate).withColumn(
        "error", calc.calc_argument_errors(F.col("principal"), F.col("rate"), F.col("days"))
    )
    return checked.select(
        "dialog", "seq", F.round("rate", 6).alias("rate"), "error", (F.col("error") == "").alias("valid"),
        F.when(
            F.col("error") == "",
            calc.penalty_amount(F.col("principal"), F.col("rate"), F.col("days"), F.col("context")),
        ).alias("penalty"),
    )


def _call(tool: str, **arguments: str) -> str:
    """SQL text of a tool call in JSON; argument values are SQL expressions giving text."""
    parts = []
    for i, (name, value) in enumerate(arguments.items()):
        parts += [f"'{',' if i else ''}\"{name}\":'", value]
    return f"CONCAT('{{\"tool\":\"{tool}\",\"arguments\":{{', " + ", ".join(parts) + ", '}}')"


_N = "CAST(o_orderkey % 40 AS STRING)"
_BIG = "CAST(o_orderkey % 300 AS STRING)"
_FENCED = _call("calculate_penalty", principal="'1000'", daily_rate_per_mille=_N, days="'30'")
_QUOTED = f"CONCAT('\"', {_N}, '\"')"
_TOOL_RAW = (
    f"CASE o_orderkey % 7 WHEN 0 THEN {_call('calculate_penalty', principal=_BIG, daily_rate_per_mille=chr(39) + '0.5' + chr(39), days=_N)} "
    f"WHEN 1 THEN CONCAT('```json', CHR(10), {_FENCED}, CHR(10), '```') "
    f"WHEN 2 THEN {_call('cite_clause', query=chr(39) + chr(34) + '违约金' + chr(34) + chr(39), top_k=_N)} "
    "WHEN 3 THEN '最终答复' "
    f"WHEN 4 THEN {_call('calculate_penalty', principal=_QUOTED, daily_rate_per_mille=chr(39) + chr(34) + 'x' + chr(34) + chr(39), days=_QUOTED)} "
    "WHEN 5 THEN '{\"tool\":\"calculate_penalty\"' "
    f"ELSE {_call('calculate_penalty', principal=chr(39) + '88' + chr(39), daily_rate_per_mille=_BIG, days=f'CONCAT(chr(45), {_N})')} END"
)


def _validate_sql() -> str:
    body = f"CASE WHEN starts_with(raw, '```') THEN {oracle.trim('''regexp_extract(raw, '^```[^\\n]*\\n((?s).*)```', 1)''')} ELSE raw END"
    num = "coalesce(TRY_CAST(json_extract_string(body, '$.arguments.{}') AS DOUBLE), 0)"
    rate = oracle.normalized_rate("r0", "'日利率'")
    error = (
        "array_to_string(list_filter([CASE WHEN NOT p > 0 THEN 'principal 必须为正数' END, "
        "CASE WHEN NOT rate > 0 THEN 'daily_rate_per_mille 必须为正数' WHEN rate > 100 THEN 'daily_rate_per_mille 超出合理范围(<= 100.0)' END, "
        "CASE WHEN NOT d > 0 THEN 'days 必须为正整数' END], lambda x: x IS NOT NULL), '; ')"
    )
    return oracle.with_(
        ("calls", f"SELECT o_custkey AS dialog, o_orderkey AS seq, {_TOOL_RAW} AS raw FROM orders"),
        ("bodies", f"SELECT dialog, seq, {body} AS body FROM calls"),
        ("parsed", f"SELECT dialog, seq, {num.format('principal')} AS p, {num.format('daily_rate_per_mille')} AS r0, CAST({num.format('days')} AS INT) AS d "
                   "FROM (SELECT * FROM bodies WHERE json_valid(body)) WHERE json_extract_string(body, '$.tool') = 'calculate_penalty'"),
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY dialog ORDER BY seq) AS rn FROM parsed"),
        ("rated", f"SELECT *, {rate} AS rate FROM ranked WHERE rn = 1"),
        ("checked", f"SELECT *, {error} AS error FROM rated"),
    ) + (
        "SELECT dialog, seq, round(rate, 6) AS rate, error, error = '' AS valid, "
        f"CASE WHEN error = '' THEN {oracle.penalty('p', 'rate', 'd', '''CAST('日利率' AS VARCHAR)''')} END AS penalty FROM checked"
    )


def amount_capitals(spark: SparkSession, sf: str) -> DataFrame:
    amounts = read_table(spark, sf, "orders").selectExpr("o_orderkey", f"{_AMOUNT} AS amount")
    return amounts.select("o_orderkey", numerals.money_capitals(F.col("amount")).alias("capitals"))


_AMOUNT = (
    "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(-o_totalprice AS DECIMAL(18,2)) "
    "WHEN 2 THEN CAST(o_orderkey * 1000 AS DECIMAL(18,2)) WHEN 3 THEN CAST(o_orderkey % 100 / 100.0 AS DECIMAL(18,2)) "
    "WHEN 4 THEN CAST(o_orderkey * 10000001 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END"
)


def _capitals_sql() -> str:
    def digit(pos: str) -> str:
        return f"CAST(substring(d12, {pos}, 1) AS INT)"

    def group(start: int) -> str:
        parts = []
        for j, unit in enumerate(["仟", "佰", "拾", ""]):
            d = digit(str(start + j))
            parts.append(f"CASE WHEN {d} = 0 THEN '0' ELSE substring('壹贰叁肆伍陆柒捌玖', {d}, 1) || '{unit}' END")
        return f"regexp_replace(trim({' || '.join(parts)}, '0'), '0+', '零', 'g')"

    cap = "substring('壹贰叁肆伍陆柒捌玖', {0}, 1)"
    return oracle.with_(
        ("a", f"SELECT o_orderkey, coalesce({_AMOUNT}, 0) AS v FROM orders"),
        ("b", "SELECT o_orderkey, v, CAST(floor(abs(v)) AS BIGINT) AS i, CAST(round((abs(v) - floor(abs(v))) * 100) AS INT) AS cents FROM a"),
        ("c", "SELECT *, lpad(CAST(i AS VARCHAR), 12, '0') AS d12 FROM b"),
        ("g", f"SELECT *, {group(1)} AS g3, {group(5)} AS g2, {group(9)} AS g1 FROM c"),
    ) + (
        "SELECT o_orderkey, CASE WHEN length(CAST(i AS VARCHAR)) <= 12 THEN CASE WHEN v < 0 THEN '负' ELSE '' END || "
        "CASE WHEN i = 0 THEN '零' ELSE CASE WHEN g3 = '' THEN '' ELSE g3 || '亿' END || CASE WHEN g2 = '' THEN '' ELSE g2 || '万' END || g1 END || '元' || "
        "CASE WHEN cents = 0 THEN '整' ELSE "
        f"CASE WHEN cents // 10 = 0 THEN '' ELSE {cap.format('cents // 10')} || '角' END || "
        f"CASE WHEN cents % 10 = 0 THEN '' ELSE CASE WHEN cents // 10 = 0 THEN '零' ELSE '' END || {cap.format('cents % 10')} || '分' END END END AS capitals FROM g"
    )


_ASKED = ("asked", inputs.ASKED.sql())
_ROUTED = (
    "routed",
    "SELECT *, coalesce(last_value(explicit_type IGNORE NULLS) OVER (PARTITION BY session_id, epoch ORDER BY turn ROWS UNBOUNDED PRECEDING), 'PENALTY') AS calc_type "
    f"FROM (SELECT *, {oracle.explicit_type('text')} AS explicit_type, sum(gap) OVER (PARTITION BY session_id ORDER BY turn) AS epoch FROM (SELECT *, "
    "CASE WHEN ts_sec - lag(ts_sec) OVER (PARTITION BY session_id ORDER BY turn) >= 604800 THEN 1 ELSE 0 END AS gap FROM asked))",
)

QUERIES = {
    "extract_params": extract_params,
    "compute_amount": compute_amount,
    "penalty": penalty,
    "loan_interest": loan_interest,
    "calc_route": calc_route,
    "cn_number": cn_number,
    "penalty_ratio": penalty_ratio,
    "validate_calc": validate_calc,
    "amount_capitals": amount_capitals,
}

ORACLES = {
    "extract_params": oracle.with_(*_PARAMS)
    + "SELECT question_id, principal, rate_per_mille, rate_specified, days, force_majeure, penalty_context FROM params",
    "compute_amount": oracle.with_(
        *_PARAMS, ("typed", _TYPED),
        ("done", f"SELECT *, {oracle.amount('calc_type', *_ARGS, 'force_majeure', 'text')} AS amount FROM typed"),
    )
    + f"SELECT question_id, calc_type, amount, {_handoff_sql()} AS handoff FROM done",
    "penalty": oracle.with_(*_PARAMS)
    + f"SELECT question_id, round({oracle.normalized_rate('rate_per_mille', 'text')}, 6) AS rate, {oracle.penalty(*_ARGS, 'text')} AS penalty FROM params",
    "loan_interest": oracle.with_(*_PARAMS)
    + f"SELECT question_id, {oracle.interest(*_ARGS)} AS simple, CASE WHEN principal >= 0 AND days >= 0 THEN "
    + oracle.cents_nearest(
        "principal * (pow(1.0::DOUBLE + CASE WHEN rate_per_mille IS NOT NULL THEN least(rate_per_mille / 1000.0 * 365.0, 0.138) END / 365.0, days) - 1.0)"
    )
    + " END AS compound FROM params",
    "calc_route": oracle.with_(_ASKED, _ROUTED) + "SELECT question_id, explicit_type, calc_type FROM routed",
    "cn_number": f"SELECT l_orderkey, l_linenumber, numeral, {_CN_SQL} AS value FROM (SELECT DISTINCT l_orderkey, l_linenumber, {_NUMERAL} AS numeral FROM lineitem)",
    "penalty_ratio": oracle.with_(
        ("contracts", inputs.CONTRACTS.sql()),
        ("r", "SELECT contract_id, text, regexp_extract(text, '百分之([零一二三四五六七八九十百0-9]+)', 1) AS numeral FROM contracts WHERE regexp_matches(text, '违约金|滞纳金')"),
        ("v", f"SELECT contract_id, {_CN_SQL} / 100.0 AS ratio FROM r WHERE numeral <> ''"),
    )
    + "SELECT contract_id, round(ratio, 6) AS ratio FROM v WHERE ratio > 0.30",
    "validate_calc": _validate_sql(),
    "amount_capitals": _capitals_sql(),
}
