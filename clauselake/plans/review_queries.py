"""Queries over clause splitting, triage, verdicts and contract review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions import json_text, rules
from clauselake.functions import lexicons as lx
from clauselake.functions import text as tx
from clauselake.operators import clauses, review, verdicts
from clauselake.operators.triage import triage as triage_op
from clauselake.plans import inputs, oracle
from clauselake.runtime import spread, written
from clauselake.sources.tables import read_table

NOW = 1_704_067_200


def contract_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return clauses.split_clauses(inputs.CONTRACTS.frame(spark, sf), ["contract_id"], "text", "label")


def split_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return contract_blocks(spark, sf)


def split_long(spark: SparkSession, sf: str) -> DataFrame:
    lines = spread(read_table(spark, sf, "lineitem"))
    texts = lines.selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{_LONG} AS text")
    # an outer explode: a plain one has the whole cut a second time, as a filter on its size
    cut = texts.withColumn("pieces", tx.split_long_clause(F.col("text")))
    pieces = cut.select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode_outer("pieces").alias("i", "piece")).filter("i IS NOT NULL")
    return pieces.select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("i") + 1).alias("sub_index"), F.length("piece").alias("chars"),
        F.substring("piece", 1, 12).alias("head"),
    )


_LONG = (
    "CASE l_linenumber % 4 "
    "WHEN 0 THEN CONCAT('第1条 总则', REPEAT('（一）甲方应当履行；', CAST(l_partkey % 7 + 1 AS INT)), '（十二） 完') "
    "WHEN 1 THEN CONCAT('第2条 ', REPEAT('乙方应当付款。并开具发票；', CAST(l_partkey % 9 + 1 AS INT))) "
    "WHEN 2 THEN CONCAT('第3条 ', REPEAT('丙', CAST(l_partkey % 400 + 700 AS INT))) "
    "ELSE CONCAT('第4条 ', CAST(l_partkey AS STRING), '（二）', REPEAT('丁', CAST(l_partkey % 300 + 650 AS INT))) END"
)


def truncate_contract(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return clauses.truncate_contracts(docs, "text").select(
        "doc_id", F.length("analysis_text").alias("chars"), F.sha2("analysis_text", 256).alias("digest"), "dropped_chars", "too_short"
    )


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    docs = clauses.with_bodies(inputs.CONTRACTS.frame(spark, sf), "text", "label")
    counted = docs.withColumn("clause_count", clauses.clause_count())
    found = clauses.missing_elements(counted, "text", "clause_count")
    return found.select("contract_id", "clause_count", F.array_join("missing", "、").alias("missing"))


def _history_questions(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.QUESTIONS.frame(spark, sf).withColumn("has_history", F.expr("question_id % 3 <> 0"))


_SCOPE_RAW = "CASE LENGTH(text) % 4 WHEN 0 THEN 'in_scope' WHEN 1 THEN 'OUT_OF_SCOPE ' WHEN 2 THEN 'out_of_scope / in_scope' ELSE NULL END"
_INTENT_RAW = "CASE LENGTH(text) % 5 WHEN 0 THEN 'Both' WHEN 1 THEN 'calculate' WHEN 2 THEN 'retrieve' WHEN 3 THEN NULL ELSE '?' END"


def triage(spark: SparkSession, sf: str) -> DataFrame:
    questions = _history_questions(spark, sf)
    raw = (
        questions.select("text").distinct()
        .selectExpr("sha2(text, 256) AS text_hash", f"{_SCOPE_RAW} AS scope_raw", f"{_INTENT_RAW} AS intent_raw")
    )
    return triage_op(questions, raw).select("question_id", "path", "rejected", "intent", "needs_verdict")


def triage_sql(source: str) -> str:
    """Columns path, calc, rejected, intent, needs_verdict over a CTE with text and has_history."""
    t = "text"
    path = (
        f"CASE WHEN {oracle.has(t, lx.HARD_OUT_OF_SCOPE)} THEN 'hard' WHEN {oracle.has(t, lx.REVIEW_ANCHORS)} THEN 'review' "
        f"WHEN {oracle.has(t, lx.IN_SCOPE_ANCHORS)} THEN 'anchor' "
        f"WHEN has_history AND {oracle.has(t, lx.ANAPHORA_MARKERS)} AND NOT {oracle.has(t, lx.CROSS_DOMAIN_WORDS)} THEN 'anaphora' "
        "ELSE 'verdict' END"
    )
    inner = (
        f"SELECT *, {path} AS path, {oracle.has(t, lx.CALC_TRIGGERS)} AS calc, "
        f"lower(coalesce({_SCOPE_RAW}, '')) AS sraw, lower(coalesce({_INTENT_RAW}, '')) AS iraw FROM {source}"
    )
    decided = (
        "SELECT *, path = 'hard' OR (path = 'verdict' AND contains(sraw, 'out_of_scope') AND NOT contains(sraw, 'in_scope')) AS rejected, "
        f"NOT (path IN ('hard', 'review') OR (path IN ('anchor', 'anaphora') AND calc)) AS needs_verdict FROM ({inner})"
    )
    # a clean "out_of_scope" also holds "in_scope" nowhere: the two words do not overlap
    return (
        "SELECT *, CASE WHEN rejected THEN NULL WHEN path = 'review' THEN 'review' WHEN calc THEN 'both' "
        f"WHEN contains(iraw, 'both') THEN 'both' WHEN contains(iraw, 'calc') THEN 'calculate' ELSE 'retrieve' END AS intent FROM ({decided})"
    )


def risk_verdict(spark: SparkSession, sf: str) -> DataFrame:
    raws = spread(read_table(spark, sf, "orders")).selectExpr("o_orderkey", f"{_RISK_RAW} AS raw")
    raw = F.col("raw")
    staged = raws.withColumn("j", json_text.judgement_struct(raw))
    return staged.select(
        "o_orderkey", rules.free_text_risk(raw).alias("text_risky"), rules.review_point(raw).alias("named_point"),
        "j.point", "j.risky", "j.risk_point", "j.basis", "j.advice",
        *[json_text.extract_section(raw, k).alias(f"section_{i}") for i, k in enumerate(lx.SECTION_KEYS)],
    )


_K = "CAST(o_orderkey AS STRING)"
_RISK_RAW = (
    "CASE o_orderkey % 9 "
    f"WHEN 0 THEN CONCAT('结论：{{\"维度\":\"数值\",\"是否有风险\":\"是\",\"风险描述\":\"利率过高', {_K}, '\",\"法律依据\":\"第585条\",\"改写建议\":\"下调\"}}。') "
    "WHEN 1 THEN '{\"维度\":\"格式\",\"是否有风险\":\"否\",\"风险描述\":\"\",\"法律依据\":\"\",\"改写建议\":\"\"}' "
    "WHEN 2 THEN '{\"维度\":\"其他\",\"是否有风险\":\"是的\"}' "
    "WHEN 3 THEN '{\"维度\":' "
    "WHEN 4 THEN NULL "
    f"WHEN 5 THEN CONCAT('风险点：条款', {_K}, CHR(10), '对一方不合理', CHR(10), '改写建议: 改为对等', CHR(10), '替换条款：双方各半') "
    "WHEN 6 THEN '未发现明显风险' "
    "WHEN 7 THEN '该条款属于语义类，存在风险' "
    "ELSE '  ' END"
).replace("{{", "{").replace("}}", "}")


def _risk_verdict_sql() -> str:
    t = oracle.trim("raw")
    blank = f"(raw IS NULL OR {t} = '')"
    body = r"coalesce(nullif(regexp_extract(raw, '(?s)(\{.*\})', 1), ''), " + t + ")"
    point = "CASE WHEN {0} IS NULL THEN 'SEMANTIC' WHEN contains({0}, '数值') THEN 'NUMERIC' WHEN contains({0}, '语义') THEN 'SEMANTIC' WHEN contains({0}, '格式') THEN 'FORMAT' WHEN contains({0}, '无关') THEN 'NONE' ELSE 'SEMANTIC' END"

    def field(name: str) -> str:
        return f"json_extract_string(body, '$.\"{name}\"')"

    def pick(ok: str, none: str, bad: str) -> str:
        return f"CASE WHEN {blank} THEN {none} WHEN ok THEN {ok} ELSE {bad} END"

    def section(i: int) -> str:
        key = lx.SECTION_KEYS[i]
        # one line-based pass: text between this title and the next one
        others = "|".join(lx.SECTION_KEYS)
        marked = rf"regexp_replace(chr(10) || raw, '\n({others})\s*[:：]', chr(1) || '\1' || chr(2), 'g')"
        part = f"list_filter(string_split({marked}, chr(1)), lambda x: starts_with(x, '{key}' || chr(2)))[1]"
        val = oracle.trim(f"coalesce(substring({part}, {len(key) + 2}), '')")
        return f"CASE WHEN {blank} THEN '（生成失败）' WHEN {val} = '' THEN {t} ELSE {val} END AS section_{i}"

    risky = f"coalesce(starts_with({field('是否有风险')}, '是'), false)"
    described = f"CASE WHEN {risky} AND coalesce({field('风险描述')}, '') = '' THEN '（模型未给出风险描述）' ELSE {field('风险描述')} END"
    return oracle.with_(
        ("r", f"SELECT o_orderkey, {_RISK_RAW} AS raw FROM orders"),
        ("b", f"SELECT *, {body} AS body0 FROM r"),
        ("c", "SELECT *, coalesce(starts_with(body0, '{') AND json_valid(body0), false) AS ok, CASE WHEN starts_with(body0, '{') AND json_valid(body0) THEN body0 END AS body FROM b"),
    ) + (
        f"SELECT o_orderkey, CASE WHEN {blank} THEN true WHEN {oracle.has('raw', lx.NO_RISK_PHRASES)} THEN false ELSE {oracle.has('raw', lx.RISK_PHRASES)} END AS text_risky, "
        f"{point.format('raw')} AS named_point, "
        f"{pick(point.format(field('维度')), chr(39) + 'SEMANTIC' + chr(39), chr(39) + 'SEMANTIC' + chr(39))} AS point, "
        f"{pick(risky, 'true', 'true')} AS risky, {pick(described, chr(39) + '（模型未返回结论）' + chr(39), chr(39) + '（结论解析失败）' + chr(39))} AS risk_point, "
        f"{pick(field('法律依据'), chr(39) * 2, chr(39) * 2)} AS basis, {pick(field('改写建议'), chr(39) * 2, chr(39) * 2)} AS advice, "
        f"{section(0)}, {section(1)}, {section(2)} FROM c"
    )


# ---- verdicts and review over contracts -------------------------------------
_CLAUSE_RAW = (
    "CASE LENGTH(content) % 7 "
    "WHEN 0 THEN NULL "
    "WHEN 1 THEN '{\"维度\":\"语义\",\"是否有风险\":\"是\",\"风险描述\":\"显失公平\",\"法律依据\":\"民法典\",\"改写建议\":\"改为对等\"}' "
    "WHEN 2 THEN '{\"维度\":\"数值\",\"是否有风险\":\"否\",\"风险描述\":\"\",\"法律依据\":\"\",\"改写建议\":\"下调比例\"}' "
    "WHEN 3 THEN '{\"维度\":\"无关\",\"是否有风险\":\"否\",\"风险描述\":\"\",\"法律依据\":\"\",\"改写建议\":\"\"}' "
    "WHEN 4 THEN '{\"维度\":\"格式\",\"是否有风险\":\"否\",\"风险描述\":\"\",\"法律依据\":\"\",\"改写建议\":\"\"}' "
    "WHEN 5 THEN '{\"维度\":\"数值\",\"是否有风险\":\"是\",\"风险描述\":\"利率过高\",\"法律依据\":\"\",\"改写建议\":\"下调\"}' "
    "ELSE '{bad' END"
)
_VERDICT_SEC = f"{NOW} - (LENGTH(content) % 10) * 86400"


def clause_verdicts(blocks: DataFrame) -> DataFrame:
    """Stands in for the stored model verdicts of the clause texts."""
    texts = blocks.select("content").distinct()
    return texts.selectExpr("sha2(content, 256) AS text_hash", f"{_CLAUSE_RAW} AS raw", f"{_VERDICT_SEC} AS verdict_sec")


def live_clause_verdicts(texts: DataFrame) -> DataFrame:
    """Stored verdicts within their lifetime; a clause without one is judged by the rules alone."""
    return verdicts.live_verdicts(clause_verdicts(texts), F.lit(NOW))


def verdict_cache(spark: SparkSession, sf: str) -> DataFrame:
    # the texts are split once, for the verdicts and for the rows that look them up
    blocks = written(contract_blocks(spark, sf).select("contract_id", "chunk_index", "content"), "contract-blocks")
    judged = verdicts.with_verdicts(blocks, clause_verdicts(blocks), "content", F.lit(NOW))
    return judged.select(
        "contract_id", "chunk_index", "text_hash", "cached",
        F.when(F.col("cached"), json_text.judgement_struct(F.col("raw"))["point"]).alias("point"),
    )


def verdict_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Clause texts without a living verdict: the batch to send to a model."""
    texts = written(contract_blocks(spark, sf).select("content").distinct(), "clause-texts")
    return verdicts.missing_texts(texts, clause_verdicts(texts), "content", F.lit(NOW))


def _clause_vectors(spark: SparkSession, sf: str):
    vectors = inputs.VECTORS.frame(spark, sf).select("vec_id", "vector")
    total = vectors.count()

    def attach(texts: DataFrame) -> DataFrame:
        keyed = texts.withColumn("vec_id", F.expr(f"CAST(CONV(SUBSTRING(SHA2(content, 256), 1, 8), 16, 10) AS BIGINT) % {total}"))
        return keyed.join(vectors, "vec_id", "left").drop("vec_id")

    return attach


def reviewed(spark: SparkSession, sf: str, contracts: DataFrame | None = None) -> DataFrame:
    contracts = inputs.CONTRACTS.frame(spark, sf) if contracts is None else contracts
    return review.review_contracts(
        contracts, inputs.statutes(spark, sf), live_clause_verdicts, _clause_vectors(spark, sf)
    )


def review_items(spark: SparkSession, sf: str) -> DataFrame:
    return reviewed(spark, sf)


def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_summary(reviewed(spark, sf), inputs.CONTRACTS.frame(spark, sf))


def review_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_anchors(reviewed(spark, sf))


def review_report(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_report(reviewed(spark, sf), inputs.CONTRACTS.frame(spark, sf))


def eval_review(spark: SparkSession, sf: str) -> DataFrame:
    from clauselake.operators.evaluate import review_rates

    expected = inputs.CONTRACTS.frame(spark, sf).selectExpr("contract_id", f"{_EXPECTED} AS expect_risk", "contract_id % 10 AS kind")
    found = review_summary(spark, sf).selectExpr("contract_id", "risks > 0 AS found_risk")
    return review_rates(expected, found)


_EXPECTED = "contract_id % 10 IN (0, 1, 2, 3, 5, 9)"


def review_ctes() -> list[tuple[str, str]]:
    """CTEs ending in ``items``."""
    from clauselake.plans.calc_queries import _CN_SQL, _handoff_sql

    numeral = "regexp_extract(content, '百分之([零一二三四五六七八九十百0-9]+)', 1)"
    ratio = f"CASE WHEN regexp_matches(content, '违约金|滞纳金') AND {numeral} <> '' THEN {_CN_SQL.replace('numeral', numeral)} / 100.0 END"
    missing = (
        "array_to_string(list_filter(["
        + ", ".join(f"CASE WHEN NOT regexp_matches(text, '{p}') THEN '{n}' END" for n, p in lx.COMPLETENESS_ITEMS)
        + "], lambda x: x IS NOT NULL), '、')"
    )
    body = r"coalesce(nullif(regexp_extract(raw, '(?s)(\{.*\})', 1), ''), raw)"

    def field(name: str) -> str:
        return f"json_extract_string(CASE WHEN json_valid({body}) THEN {body} END, '$.\"{name}\"')"

    point = field("维度")
    return [
        ("contracts", inputs.CONTRACTS.sql()),
        *oracle.split_ctes("contracts", "contract_id"),
        ("statutes", inputs.STATUTES.sql()),
        ("labelled", f"SELECT *, NOT (ends_with(canonical_id, '{lx.INTRO_SUFFIX}') OR ends_with(canonical_id, '{lx.WHOLE_SUFFIX}')) AS is_clause, "
                     f"coalesce(nullif(regexp_extract(content, '^(第[{lx.CLAUSE_DIGITS}]+条)', 1), ''), canonical_id) AS clause_label FROM blocks"),
        ("texts", "SELECT DISTINCT content, sha256(content) AS query_id, '1' AS kb_id FROM labelled WHERE is_clause"),
        ("rq", "SELECT query_id, kb_id, content AS text, v.embedding AS vector FROM texts LEFT JOIN embeddings v ON v.vec_id = CAST('0x' || substring(sha256(content), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)"),
        *oracle.hybrid_ctes("rq", "statutes", lx.REVIEW_TOP_K),
        ("basis", "SELECT query_id, max(score) AS top_score, string_agg(clause_id, '; ' ORDER BY rank) AS legal_basis FROM fused GROUP BY query_id"),
        *oracle.params_ctes("texts", "query_id", "content"),
        ("typed", f"SELECT query_id, content, content AS text, principal, rate_per_mille, rate_specified, days, force_majeure, coalesce({oracle.explicit_type('content')}, 'PENALTY') AS calc_type FROM params"),
        ("amounted", f"SELECT *, {oracle.amount('calc_type', 'principal', 'rate_per_mille', 'days', 'force_majeure', 'content')} AS amount FROM typed"),
        ("judged0", f"SELECT *, {_handoff_sql()} AS numeric_validation, {ratio} AS ratio, CASE WHEN {_VERDICT_SEC} > {NOW} - 7 * 86400 THEN {_CLAUSE_RAW} END AS raw, "
                    f"calc_type = 'LOAN_INTEREST' AND rate_specified AND coalesce({oracle.normalized_rate('rate_per_mille', 'content')} > 0.378, false) AS loan_anomaly FROM amounted"),
        ("judged1", f"SELECT j.*, top_score, legal_basis, CASE WHEN raw IS NULL OR NOT json_valid({body}) THEN 'SEMANTIC' WHEN contains({point}, '数值') THEN 'NUMERIC' WHEN contains({point}, '语义') THEN 'SEMANTIC' "
                    f"WHEN contains({point}, '格式') THEN 'FORMAT' WHEN contains({point}, '无关') THEN 'NONE' ELSE 'SEMANTIC' END AS point, "
                    f"CASE WHEN raw IS NULL OR NOT json_valid({body}) THEN true ELSE starts_with({field('是否有风险')}, '是') END AS vrisky, "
                    f"CASE WHEN raw IS NULL THEN '（模型未返回结论）' WHEN NOT json_valid({body}) THEN '（结论解析失败）' ELSE {field('风险描述')} END AS vtext, "
                    f"CASE WHEN raw IS NULL OR NOT json_valid({body}) THEN '' ELSE {field('改写建议')} END AS advice, "
                    f"coalesce(top_score, 0) < {lx.LOW_SCORE} AS low_relevance FROM judged0 j LEFT JOIN basis USING (query_id)"),
        ("judged2", "SELECT *, loan_anomaly OR coalesce(ratio > 0.30, false) AS numeric_anomaly FROM judged1"),
        ("judged", "SELECT *, CASE WHEN point IN ('NUMERIC', 'NONE') THEN numeric_anomaly ELSE vrisky OR low_relevance END AS risky FROM judged2"),
        ("clause_items", "SELECT contract_id, chunk_index AS pos, clause_label, l.content AS clause_text, legal_basis, numeric_validation, coalesce(risky, false) AS risky, "
                         "coalesce(numeric_anomaly, false) AS numeric_anomaly, coalesce(low_relevance, false) AS low_relevance, "
                         "CASE WHEN risky AND point = 'NUMERIC' THEN CASE WHEN ratio > 0.30 THEN '违约金比例畸高：约定为' || CAST(round(ratio * 100) AS BIGINT) || '%，超过《民法典》第585条参照的30%上限' "
                         "ELSE coalesce(nullif(vtext, ''), '数值超出法定/合理区间') END WHEN risky AND point IN ('SEMANTIC', 'FORMAT') THEN vtext END AS risk_point, "
                         "CASE WHEN risky AND point <> 'NONE' THEN advice END AS rewrite_suggestion, CASE WHEN risky AND point IN ('SEMANTIC', 'FORMAT') THEN advice END AS clause_replacement "
                         "FROM labelled l LEFT JOIN judged j ON l.is_clause AND l.content = j.content"),
        ("counts", "SELECT contract_id, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (is_clause) AS INT) AS clause_count FROM labelled GROUP BY contract_id"),
        ("lacking", f"SELECT contract_id, clause_count, n, CASE WHEN clause_count >= 2 OR (clause_count = 0 AND length(text) >= 8) THEN {missing} ELSE '' END AS m0 FROM contracts JOIN counts USING (contract_id)"),
        ("lack", "SELECT *, CASE WHEN contains(m0, '、') THEN m0 ELSE '' END AS missing FROM lacking"),
        ("items", "SELECT * FROM clause_items UNION ALL SELECT contract_id, n, '【合同完备性】', '整份合同要素检查', NULL, NULL, true, false, false, '缺少必要要素：' || missing, '建议补充约定：' || missing, NULL FROM lack WHERE missing <> ''"),
    ]


_SPLIT = [("contracts", inputs.CONTRACTS.sql()), *oracle.split_ctes("contracts", "contract_id")]
_ITEMS = oracle.with_(*review_ctes(), recursive=True)
_REPORT_BODY = (
    "chr(10) || (pos + 1) || '. ' || clause_label || chr(10) || '【原文】' || clause_text || chr(10) || "
    "CASE WHEN legal_basis IS NOT NULL THEN '【法规依据】' || legal_basis || '; ' || chr(10) ELSE '' END || "
    "CASE WHEN numeric_validation IS NOT NULL THEN '【数值校验】' || numeric_validation || chr(10) ELSE '' END || "
    "CASE WHEN risky THEN '【风险点】' || coalesce(risk_point, '（见下方建议）') || chr(10) || '【改写建议】' || coalesce(rewrite_suggestion, '（无）') || chr(10) || "
    "'【建议替换条款】' || coalesce(clause_replacement, '（无）') || chr(10) ELSE '【结论】未发现明显风险。' || chr(10) END"
)

REPORT_SQL = (
    "'合同审查报告' || chr(10) || '（共审查 ' || coalesce(n, 0) || ' 条，发现风险 ' || coalesce(r, 0) || ' 条）' || chr(10) || "
    "'================================' || chr(10) || coalesce(body, '')"
)

QUERIES = {
    "split_clauses": split_clauses,
    "split_long": split_long,
    "truncate_contract": truncate_contract,
    "completeness": completeness,
    "triage": triage,
    "risk_verdict": risk_verdict,
    "verdict_cache": verdict_cache,
    "verdict_missing": verdict_missing,
    "review_items": review_items,
    "review_summary": review_summary,
    "review_anchors": review_anchors,
    "review_report": review_report,
    "eval_review": eval_review,
}

_LONG_SUBS = (
    f"CASE WHEN regexp_matches(body, '{lx.SUB_MARK}') THEN list_transform(string_split(regexp_replace(body, '({lx.SUB_MARK})', chr(1) || '\\1', 'g'), chr(1))[2:], lambda x: {oracle.trim('x')}) "
    f"ELSE list_filter(list_transform(string_split_regex(body, '[；。]'), lambda x: {oracle.trim('x')}), lambda x: x <> '') END"
)

ORACLES = {
    "split_clauses": oracle.with_(*_SPLIT, recursive=True)
    + "SELECT contract_id, chunk_index, canonical_id, sub_index, chunk_id, content FROM blocks",
    "split_long": oracle.with_(
        ("t", f"SELECT l_orderkey, l_linenumber, l_partkey, {_LONG} AS body FROM lineitem"),
        ("s", f"SELECT *, {_LONG_SUBS} AS subs FROM t"),
        ("c", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN len(subs) = 1 AND length(subs[1]) > 800 THEN list_transform(range(0, CAST(ceil(length(body) / 800.0) AS BIGINT)), lambda n: {oracle.trim('substring(body, n * 800 + 1, 800)')}) ELSE subs END AS subs FROM s"),
        ("u", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(unnest(range(1, len(subs) + 1)) AS INT) AS sub_index, unnest(subs) AS piece FROM c"),
    )
    + "SELECT l_orderkey, l_linenumber, l_partkey, sub_index, CAST(length(piece) AS INT) AS chars, substring(piece, 1, 12) AS head FROM u",
    "truncate_contract": "SELECT doc_id, CAST(length(t) AS INT) AS chars, sha256(t) AS digest, CAST(greatest(length(text) - 8000, 0) AS INT) AS dropped_chars, too_short FROM "
    "(SELECT *, CASE WHEN too_short THEN NULL WHEN length(text) > 8000 THEN substring(text, 1, 8000) || '...（文本过长，已截断）' ELSE text END AS t FROM "
    f"(SELECT doc_id, text, length({oracle.trim('text')}) < 10 AS too_short FROM documents))",
    "completeness": oracle.with_(*[c for c in review_ctes() if c[0] in {"contracts", "labelled", "counts", "lacking", "lack", "blocks"} or c[0].startswith("sp_")], recursive=True)
    + "SELECT c.contract_id, coalesce(clause_count, 0) AS clause_count, coalesce(missing, '') AS missing FROM contracts c LEFT JOIN lack USING (contract_id)",
    "triage": oracle.with_(("q", f"SELECT *, question_id % 3 <> 0 AS has_history FROM ({inputs.QUESTIONS.sql()})"))
    + f"SELECT question_id, path, rejected, intent, needs_verdict FROM ({triage_sql('q')})",
    "risk_verdict": _risk_verdict_sql(),
    "verdict_cache": oracle.with_(
        *_SPLIT,
        ("v", f"SELECT content, {_CLAUSE_RAW} AS raw, {_VERDICT_SEC} AS verdict_sec FROM (SELECT DISTINCT content FROM blocks)"),
        ("live", f"SELECT content, raw FROM v WHERE verdict_sec > {NOW} - 7 * 86400"),
        recursive=True,
    )
    + "SELECT contract_id, chunk_index, sha256(b.content) AS text_hash, live.content IS NOT NULL AS cached, CASE WHEN live.content IS NULL THEN NULL WHEN raw IS NULL OR NOT json_valid(raw) THEN 'SEMANTIC' "
    "WHEN contains(json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.\"维度\"'), '数值') THEN 'NUMERIC' WHEN contains(json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.\"维度\"'), '语义') THEN 'SEMANTIC' "
    "WHEN contains(json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.\"维度\"'), '格式') THEN 'FORMAT' ELSE 'NONE' END AS point FROM blocks b LEFT JOIN live ON b.content = live.content",
    "verdict_missing": oracle.with_(
        *_SPLIT, ("v", f"SELECT content, {_VERDICT_SEC} AS verdict_sec FROM (SELECT DISTINCT content FROM blocks)"), recursive=True
    )
    + f"SELECT sha256(content) AS text_hash, content FROM v WHERE verdict_sec <= {NOW} - 7 * 86400",
    "review_items": _ITEMS + "SELECT * FROM items",
    "review_summary": _ITEMS + "SELECT contract_id, coalesce(reviewed, 0) AS reviewed, coalesce(risks, 0) AS risks FROM contracts LEFT JOIN (SELECT contract_id, count(*) AS reviewed, count(*) FILTER (risky) AS risks FROM items GROUP BY contract_id) USING (contract_id)",
    "review_anchors": _ITEMS
    + "SELECT contract_id, string_agg('【已审查条款】' || anchor || chr(10), '' ORDER BY pos) AS note FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY pos) AS rn "
    f"FROM (SELECT contract_id, {oracle.trim('clause_text')} AS anchor, min(pos) AS pos FROM items WHERE risky AND {oracle.trim('clause_text')} <> '' GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY contract_id",
    "review_report": _ITEMS
    + f"SELECT contract_id, {REPORT_SQL} AS report "
    f"FROM contracts LEFT JOIN (SELECT contract_id, count(*) AS n, count(*) FILTER (risky) AS r, string_agg({_REPORT_BODY}, '' ORDER BY pos) AS body FROM items GROUP BY contract_id) USING (contract_id)",
    "eval_review": _ITEMS
    + f"SELECT kind, count(*) AS cases, count(*) FILTER (expect_risk) AS positives, round(avg(CASE WHEN expect_risk = found THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy, "
    "round(avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (expect_risk), 6) AS detection_rate, round(avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (NOT expect_risk), 6) AS false_alarm_rate "
    f"FROM (SELECT contract_id, contract_id % 10 AS kind, {_EXPECTED} AS expect_risk, coalesce(risks > 0, false) AS found FROM contracts LEFT JOIN "
    "(SELECT contract_id, count(*) FILTER (risky) AS risks FROM items GROUP BY contract_id) USING (contract_id)) GROUP BY kind",
}
