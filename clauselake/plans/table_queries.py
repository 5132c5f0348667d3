"""Queries over tables, intake, engagement, letters and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.operators import clauses, engage, letters
from clauselake.operators.clauses import split_clauses
from clauselake.operators.postings import bm25_hits
from clauselake.operators.skew import lookup_join
from clauselake.plans import inputs, memory_queries, oracle
from clauselake.runtime import scratch_path, spread
from clauselake.sources import records, sinks
from clauselake.sources.chunk_store import ChunkStore
from clauselake.sources.tables import read_table, stream_table
from clauselake.streaming import jobs

USER = 3


# ---- plain tables ------------------------------------------------------------
_KB = {
    "id": "c_custkey", "name": "c_name", "type": "CASE WHEN c_custkey % 5 = 0 THEN 'public' ELSE 'private' END",
    "user_id": "CAST(c_nationkey AS BIGINT)", "created_at": "c_custkey * 37 % 1009", "is_deleted": "CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END",
}
_DOC = {
    "id": "o_orderkey", "kb_id": "o_custkey", "file_name": "CONCAT('f', CAST(o_orderkey AS STRING), '.txt')",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END",
}
_REC = {
    "id": "o_orderkey", "user_id": "o_custkey", "record_name": "o_orderpriority",
    "status": "CASE WHEN o_orderstatus = 'P' THEN '0' ELSE '1' END", "create_time": "o_orderkey",
    "file_urls": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CONCAT('[\"/a/', CAST(o_orderkey AS STRING), '.png\",\"/b.png\"]') END",
    "risk_points_json": "CASE WHEN o_orderkey % 4 = 0 THEN '[]' ELSE CONCAT('[{\"chapter\":\"第', CAST(o_orderkey % 9 AS STRING), '条\",\"riskWarning\":\"注意\"}]') END",
}


def _pick(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def kb_visible(spark: SparkSession, sf: str) -> DataFrame:
    return records.visible_bases(read_table(spark, sf, "customer").selectExpr(*_pick(_KB)), USER)


def kb_visible_users(spark: SparkSession, sf: str) -> DataFrame:
    """For all users of the event log at once."""
    users = read_table(spark, sf, "events").select("user_id")
    return records.visible_to_users(read_table(spark, sf, "customer").selectExpr(*_pick(_KB)), users).select("viewer_id", "id", "type")


def kb_documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").selectExpr(*_pick(_DOC)).orderBy("kb_id", F.desc("id"))


def review_records(spark: SparkSession, sf: str) -> DataFrame:
    live = records.active_records(read_table(spark, sf, "orders").selectExpr(*_pick(_REC)))
    return live.select(
        "id", "user_id", "record_name", F.array_join("file_url_list", "|").alias("urls"),
        F.coalesce(F.array_join(F.transform("risk_points", lambda p: F.concat(p["risk_number"], F.lit(":"), p["chapter"], F.lit(":"), p["original_text"])), "|"), F.lit("")).alias("risks"),
    )


def category_children(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.categories(spark, sf).select("parent_id", "id", "name", "icon", "sort_order").orderBy("parent_id", "sort_order")


def category_posts(spark: SparkSession, sf: str) -> DataFrame:
    posts = inputs.POSTS.frame(spark, sf)
    known = records.exists_in(posts, inputs.categories(spark, sf), F.col("category_id"), "id")
    return known.select("category_id", "id", "title", "excerpt", "cover_image")


def _favorites(spark: SparkSession, sf: str) -> DataFrame:
    toggles = inputs.INTERACTIONS.frame(spark, sf).filter("action = 'favorite'")
    known = records.exists_in(toggles, inputs.POSTS.frame(spark, sf), F.col("post_id"), "id")
    return engage.toggled(known, ["user_id", "post_id"])


def favorite_toggle(spark: SparkSession, sf: str) -> DataFrame:
    return _favorites(spark, sf)


def favorite_posts(spark: SparkSession, sf: str) -> DataFrame:
    posts = inputs.POSTS.frame(spark, sf).select(F.col("id").alias("post_id"), "title", "content", "cover_image")
    return lookup_join(_favorites(spark, sf), posts, ["post_id"], "inner").select("user_id", "post_id", "title", "content", "cover_image")


def category_tree(spark: SparkSession, sf: str) -> DataFrame:
    return engage.category_tree(inputs.categories(spark, sf))


#: some suppliers appear once more, as the parent of their own nation, and some as their own parent
_LOOPS_SQL = (
    "SELECT CAST(100 + s_nationkey AS BIGINT) AS id, s_name AS name, 1000 + s_suppkey AS parent_id FROM supplier WHERE s_suppkey % 4 = 0 "
    "UNION ALL SELECT 1000 + s_suppkey, s_name, 1000 + s_suppkey FROM supplier WHERE s_suppkey % 5 = 0"
)


def _looped(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = read_table(spark, sf, "supplier")
    back = suppliers.filter("s_suppkey % 4 = 0").selectExpr("CAST(100 + s_nationkey AS BIGINT) AS id", "s_name AS name", "1000 + s_suppkey AS parent_id")
    own = suppliers.filter("s_suppkey % 5 = 0").selectExpr("1000 + s_suppkey AS id", "s_name AS name", "1000 + s_suppkey AS parent_id")
    return inputs.categories(spark, sf).select("id", "name", "parent_id").unionByName(back).unionByName(own)


def category_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Where a category table with loops leads back into itself."""
    return engage.category_cycles(_looped(spark, sf)).select("root_id", "id", "parent_id", "depth", "path")


_CHANGE = {
    "id": "o_custkey", "version": "o_orderkey", "changed": "o_orderkey * 10", "op": "CASE WHEN o_orderstatus = 'P' THEN 'delete' ELSE 'write' END",
    "record_name": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END", "total": "CAST(FLOOR(o_totalprice) AS BIGINT)",
}


def apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    log = read_table(spark, sf, "orders").selectExpr(*_pick(_CHANGE))
    return records.apply_changes(log, ["id"], ["record_name", "total"])


_UPDATE = {
    "c_custkey": "c_custkey", "c_name": "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN CONCAT('新', c_name) ELSE NULL END",
    "c_mktsegment": "CASE WHEN c_custkey % 4 = 0 THEN 'OTHER' ELSE '' END",
}


def partial_update(spark: SparkSession, sf: str) -> DataFrame:
    users = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    updates = users.selectExpr(*_pick(_UPDATE)).filter("c_custkey % 5 <> 4")
    return records.partial_update(users, updates, "c_custkey", ["c_name", "c_mktsegment"])


def user_upsert(spark: SparkSession, sf: str) -> DataFrame:
    logins = read_table(spark, sf, "events").selectExpr(
        "CONCAT('u', CAST(user_id AS STRING)) AS open_id", "CASE WHEN event_type = 'error' THEN '' ELSE CONCAT('n', CAST(event_id AS STRING)) END AS nick_name",
        "CASE WHEN value < 20 THEN NULL ELSE event_type END AS avatar_url", "event_id AS seq",
    )
    known = read_table(spark, sf, "nation").selectExpr("CONCAT('u', CAST(n_nationkey AS STRING)) AS open_id")
    return records.upsert_users(logins, known)


def assemble_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "conversations").selectExpr("conv_id AS record_id", "turn + 1 AS page", "text")
    done = records.assemble_pages(pages)
    return done.select("record_id", "pages", F.sha2("text", 256).alias("digest"))


_LINE = (
    "CASE event_type WHEN 'view' THEN CONCAT('data: {\"type\":\"answer\",\"role\":\"assistant\",\"content\":\"答', CAST(event_id AS STRING), '\"}') "
    "WHEN 'click' THEN CONCAT('  data:{\"type\":\"follow_up\",\"role\":\"assistant\",\"content\":\"', CASE WHEN event_id % 4 = 0 THEN '' ELSE '追问' END, '\"}') "
    "WHEN 'error' THEN 'event: conversation.chat.completed' WHEN 'signup' THEN 'data: [DONE]' "
    "ELSE CASE WHEN event_id % 3 = 0 THEN 'data: {bad' WHEN event_id % 3 = 1 THEN 'data: {\"type\":\"verbose\",\"role\":\"assistant\",\"content\":\"x\"}' ELSE 'data: {\"type\":\"answer\",\"role\":\"user\",\"content\":\"q\"}' END END"
)


#: a message is what a user's log says within some hundred events
_MESSAGE = "user_id * 1000000 + CAST(FLOOR(event_id / 400) AS BIGINT)"


def chat_chunks(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_table(spark, sf, "events").selectExpr(f"{_MESSAGE} AS message_id", "event_id AS seq", f"{_LINE} AS line")
    typed = records.chat_chunks(lines)
    kinds = typed.groupBy("message_id").agg(F.count_if(F.col("chunk_type") == "suggestion").alias("suggestions"))
    answers = records.full_answers(typed).select("message_id", "chunks", F.sha2("text", 256).alias("digest"))
    return kinds.join(answers, "message_id", "left")


def scan_text(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "texts")
    items = read_table(spark, sf, "benchmark").select("item_id", "text")
    items.repartition("item_id").write.partitionBy("item_id").text(path)
    scanned = records.scan_text(spark, path)
    # the line writer ends each file with a newline
    return scanned.select(F.col("item_id").cast("bigint").alias("item_id"), F.regexp_replace("content", r"\n\z", "").alias("content"))


def _ingested(spark: SparkSession, sf: str) -> ChunkStore:
    """All contracts, then revised ones in a second call, as a later upload brings them."""
    contracts = inputs.CONTRACTS.frame(spark, sf)
    blocks = split_clauses(contracts, ["contract_id", "user_id"], "text", "label")
    kb = "CAST(user_id % 4 AS STRING) AS kb_id"
    first = blocks.selectExpr("chunk_id", kb, "canonical_id", "content", "1 AS written_at")
    again = blocks.filter("contract_id % 10 IN (0, 1, 9)").selectExpr(
        "chunk_id", kb, "canonical_id", "CONCAT('（修订）', content) AS content", "2 AS written_at"
    )
    path = scratch_path(spark, "chunks")
    sinks.write_chunks(first, path)
    sinks.write_chunks(again, path)
    return ChunkStore(spark, path)


def ingest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf).chunks().select("chunk_id", "kb_id", "canonical_id", "content", "written_at")


def ingest_search(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical search over the store's index after two uploads and the removal of whole-clause chunks of some contracts."""
    store = _ingested(spark, sf)
    store.remove(store.chunks().filter("chunk_id LIKE 'doc%3-第2条'").select("chunk_id"))
    questions = inputs.ASKED.frame(spark, sf).selectExpr("CAST(question_id AS STRING) AS query_id", "CAST(user_id % 4 AS STRING) AS kb_id", "text")
    return bm25_hits(questions, store.index(), 5).select("query_id", "chunk_id", "clause_id", "score", "rank")


def ingest_status(spark: SparkSession, sf: str) -> DataFrame:
    bodies = clauses.with_bodies(inputs.CONTRACTS.frame(spark, sf), "text", "label")
    counts = bodies.select(F.col("contract_id").alias("doc_id"), clauses.block_total().alias("chunk_count"))
    uploads = read_table(spark, sf, "orders").selectExpr(
        "o_orderkey AS doc_id", "CASE WHEN o_orderkey % 13 = 5 THEN 'parse error' END AS error", "o_orderkey % 11 <> 3 AS parsed"
    )
    return records.document_status(uploads, counts).select("doc_id", "status", "chunk_count")


_RESPONSE = (
    "CASE o_orderkey % 6 WHEN 0 THEN CONCAT('```json', CHR(10), '[{\"riskNumber\":\"R', CAST(o_orderkey AS STRING), '\",\"chapter\":\"第一条\",\"originalText\":\"押金\",\"riskWarning\":\"过高\"},{\"chapter\":\"第二条\"}]', CHR(10), '```') "
    "WHEN 1 THEN CONCAT('结果 {\"riskNumber\":\"单', CAST(o_orderkey AS STRING), '\"} 完') WHEN 2 THEN '[]' WHEN 3 THEN '没有' "
    "WHEN 4 THEN '[{\"riskNumber\":\"x\"}, {\"originalText\":\"y\"}, {}]' ELSE '[{\"riskNumber\":' END"
)


def risk_points(spark: SparkSession, sf: str) -> DataFrame:
    from clauselake.functions import json_text

    orders = spread(read_table(spark, sf, "orders"))
    raw = orders.selectExpr("o_orderkey AS record_id", f"{_RESPONSE} AS raw")
    points = raw.select("record_id", F.posexplode_outer(json_text.risk_points(F.col("raw"))).alias("pos", "p"))
    return points.filter("pos IS NOT NULL").select("record_id", "pos", "p.*")


def page_review(spark: SparkSession, sf: str) -> DataFrame:
    """Page sets reviewed from their pages to the stored record."""
    pages = read_table(spark, sf, "conversations").selectExpr("conv_id AS record_id", "turn + 1 AS page", "text")
    answers = pages.select("record_id").distinct().selectExpr("record_id", f"{_RESPONSE.replace('o_orderkey', 'record_id')} AS raw")
    done = records.page_review(pages, answers)
    return done.select(
        "record_id", "pages", F.sha2("contract_text", 256).alias("digest"), F.length("analysis_text").alias("analysed"), "risk_count",
        F.coalesce(F.array_join(F.transform("risk_points", lambda p: p["risk_number"]), "|"), F.lit("")).alias("numbers"), "status",
    )


# ---- engagement --------------------------------------------------------------
def _interactions(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.INTERACTIONS.frame(spark, sf)
    return rows.withColumn("at", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))


def clamped_counter(spark: SparkSession, sf: str) -> DataFrame:
    marks = _interactions(spark, sf).filter("action IN ('like', 'unlike')").withColumn("delta", F.expr("CASE WHEN action = 'like' THEN 1 ELSE -1 END"))
    marks = engage.busy_blocks(marks.filter("post_id IS NOT NULL"), ["post_id"])
    return engage.clamped_counter(marks, ["post_id"], ["at", "event_id"], F.col("block"))


def guarded_likes(spark: SparkSession, sf: str) -> DataFrame:
    return engage.guarded_marks(_interactions(spark, sf), "like", "unlike").select("event_id", "user_id", "post_id", "action", "accepted")


def post_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _interactions(spark, sf)
    return engage.post_stats(
        rows, engage.guarded_marks(rows, "like", "unlike"), engage.guarded_marks(rows, "favorite", "unfavorite")
    )


# ---- letters -----------------------------------------------------------------
_REFUND_BODY = "致${recipientName}（${recipientId}）：${senderName}于${contractYear}年${contractMonth}月${contractDay}日签订${contractName}（编号${contractNumber}），押金${depositAmount}元（${depositAmountChinese}）。第${terminationTypeChinese}种：${terminationReasonContent}请在${deadlineDays}日内汇至${bankName}${bankAccountNumber}。${senderNameSign} ${sendYear}-${sendMonth}-${sendDay} 附：${attachments}"
_REQUEST = {
    "request_id": "o_orderkey", "template_id": "1", "recipient_name": "CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE CONCAT('收', CAST(o_custkey AS STRING)) END",
    "sender_name": "CONCAT('发', CAST(o_orderkey AS STRING))", "contract_year": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '2024' END",
    "contract_month": "CAST(o_orderkey % 12 + 1 AS STRING)", "contract_day": "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 28 + 1 AS STRING) END",
    "contract_name": "CASE WHEN o_orderkey % 2 = 0 THEN '租赁合同' END", "deposit_amount": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END",
    "termination_type": "CASE o_orderkey % 5 WHEN 0 THEN '按期终止' WHEN 1 THEN '协议解除' WHEN 2 THEN '其他原因' WHEN 3 THEN NULL ELSE '未知' END",
    "termination_year1": "'2025'", "termination_month1": "CASE WHEN o_orderkey % 10 = 0 THEN '3' END", "termination_day1": "'9'",
    "termination_year2": "CASE WHEN o_orderkey % 10 = 1 THEN '2026' END", "termination_month2": "'4'", "termination_day2": "'1'",
    "other_reason": "CASE WHEN o_orderkey % 10 = 2 THEN '房屋漏水' END", "deadline_days": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 30 AS INT) END",
    "send_date": "CASE o_orderkey % 3 WHEN 0 THEN '2024年1月5日' WHEN 1 THEN '2023年11月20日' ELSE '' END",
}


def render_letters(spark: SparkSession, sf: str) -> DataFrame:
    requests = spread(read_table(spark, sf, "orders")).selectExpr(*_pick(_REQUEST))
    templates = spark.createDataFrame([(1, "deposit_refund", _REFUND_BODY)], "template_id int, kind string, body string")
    done = letters.render_letters(requests, templates, "deposit_refund", F.lit("2024-02-03").cast("date"))
    return done.select("request_id", "letter", F.sha2("letter_base64", 256).alias("base64_digest"), "letter_bytes")


_COMPLAINT_BODY = "${complainantName}（${complainantPhone}）诉${businessName}：${purchaseYear}年${purchaseMonth}月${purchaseDay}日购买${productServiceName}，总价${totalPrice}元（${totalPriceChinese}），损失${economicLoss}元。${discoveryYear}年${discoveryMonth}月${discoveryDay}日${discoveryHour}时发现${problemDescription}。承诺：${businessCommitment}；${serviceCompletionDays}日。${subsequentDate1}/${subsequentDate2} ${complaintDate} ${attachmentList}"
_COMPLAINT = {
    "request_id": "o_orderkey", "template_id": "1", "complainant_name": "CONCAT('诉', CAST(o_custkey AS STRING))",
    "business_name": "CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE CONCAT('商', CAST(o_orderkey AS STRING)) END",
    "purchase_year": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '2024' END", "purchase_month": "CAST(o_orderkey % 12 + 1 AS STRING)",
    "product_service_name": "o_orderpriority", "total_price": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END",
    "discovery_hour": "CASE WHEN o_orderkey % 2 = 0 THEN '9' END", "problem_description": "'破损'",
    "business_commitment": "CASE o_orderkey % 3 WHEN 0 THEN CONCAT('$', '{serviceCompletionDays}日内修好') WHEN 1 THEN '' ELSE '保修' END",
    "service_completion_days": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS INT) END",
    "subsequent_date1": "CASE WHEN o_orderkey % 6 = 0 THEN '2024年3月4日' END", "complaint_date": "CASE WHEN o_orderkey % 2 = 0 THEN '2024年5月6日' ELSE ' ' END",
    "attachment_list": "CASE WHEN o_orderkey % 5 = 1 THEN '收据' END",
}


def complaint_letters(spark: SparkSession, sf: str) -> DataFrame:
    requests = spread(read_table(spark, sf, "orders")).selectExpr(*_pick(_COMPLAINT))
    templates = spark.createDataFrame([(1, "consumer_complaint", _COMPLAINT_BODY), (2, "deposit_refund", "x")], "template_id int, kind string, body string")
    done = letters.render_letters(requests, templates, "consumer_complaint", F.lit("2024-02-03").cast("date"))
    return done.select("request_id", "letter", "letter_bytes")


def _complaint_sql() -> str:
    from clauselake.plans.calc_queries import _AMOUNT, _capitals_sql

    days = "coalesce(CAST(service_completion_days AS VARCHAR), '____')"
    text = lambda col: f"CASE WHEN trim(coalesce({col}, '')) = '' THEN '' ELSE {col} END"
    pledge = (
        f"CASE WHEN trim(coalesce(business_commitment, '')) = '' THEN '如商品质保1年、7天无理由退货、服务在' || {days} || '日内完成等' "
        f"ELSE replace(business_commitment, '${{serviceCompletionDays}}', {days}) END"
    )
    attachments = "'" + letters.DEFAULT_ATTACHMENTS.replace("\n", "' || chr(10) || '") + "'"
    letter = (
        f"complainant_name || '（）诉' || {text('business_name')} || '：' || coalesce(purchase_year, '____') || '年' || purchase_month || '月__日购买' || product_service_name || '，总价' || "
        f"coalesce(CAST(total_price AS VARCHAR), '{letters.NO_AMOUNT}') || '元（' || CASE WHEN total_price IS NULL THEN '{letters.NO_CAPITALS}' ELSE capitals END || '），损失{letters.NO_AMOUNT}元。____年__月__日' || "
        f"coalesce(discovery_hour, '__') || '时发现破损。承诺：' || {pledge} || '；' || {days} || '日。' || coalesce(subsequent_date1, '____年__月__日') || '/____月__日 ' || "
        f"CASE WHEN trim(complaint_date) = '' THEN '2024年02月03日' ELSE complaint_date END || ' ' || coalesce(attachment_list, {attachments})"
    )
    return oracle.with_(
        ("caps", _capitals_sql().replace(_AMOUNT, "CAST(o_totalprice AS DECIMAL(18,2))")),
        ("rq", f"SELECT {', '.join(_pick(_COMPLAINT))} FROM orders"),
        ("l", f"SELECT request_id, {letter} AS letter FROM rq JOIN caps ON o_orderkey = request_id"),
    ) + "SELECT request_id, letter, CAST(octet_length(encode(letter)) AS INT) AS letter_bytes FROM l"


def _letters_sql() -> str:
    from clauselake.plans.calc_queries import _AMOUNT, _capitals_sql

    capitals = _capitals_sql().replace(_AMOUNT, "CAST(o_totalprice AS DECIMAL(18,2))")

    def text(col: str, default: str) -> str:
        return f"CASE WHEN trim(coalesce({col}, '')) = '' THEN '{default}' ELSE {col} END"

    def two(col: str) -> str:
        return f"CASE WHEN trim(coalesce({col}, '')) = '' THEN '__' ELSE lpad(trim({col}), 2, '0') END"

    nl = "chr(13) || chr(10)"
    d1 = f"CASE WHEN termination_month1 IS NULL THEN '2025年____月____日' ELSE '2025年' || termination_month1 || '月9日' END"
    d2 = f"CASE WHEN termination_year2 IS NULL THEN '{letters.NO_DATE}' ELSE termination_year2 || '年4月1日' END"
    kind = "coalesce(termination_type, '')"
    reason = (
        f"{nl} || CASE WHEN {kind} = '按期终止' THEN '☑{letters.ENDED[0]}' || {d1} ELSE '□{letters.ENDED[0]}{letters.NO_DATE}' END || '{letters.ENDED[1]}' || {nl} || {nl} || "
        f"CASE WHEN {kind} = '协议解除' THEN '☑{letters.AGREED[0]}' || {d2} ELSE '□{letters.AGREED[0]}{letters.NO_DATE}' END || '{letters.AGREED[1]}' || {nl} || {nl} || "
        f"CASE WHEN {kind} = '其他原因' THEN '☑{letters.OTHER[0]}' || coalesce(other_reason, '{letters.NO_REASON}') ELSE '□{letters.OTHER[0]}{letters.NO_REASON}' END || '{letters.OTHER[1]}'"
    )
    letter = (
        f"'致' || {text('recipient_name', '')} || '（）：' || sender_name || '于' || coalesce(contract_year, '____') || '年' || {two('contract_month')} || '月' || {two('contract_day')} || '日签订' || "
        f"coalesce(contract_name, '合同/协议') || '（编号），押金' || coalesce(CAST(deposit_amount AS VARCHAR), '______') || '元（' || CASE WHEN deposit_amount IS NULL THEN '{letters.NO_CAPITALS}' ELSE capitals END || '）。第' || "
        f"CASE {kind} WHEN '按期终止' THEN '一' WHEN '协议解除' THEN '二' WHEN '其他原因' THEN '三' ELSE '____' END || '种：' || {reason} || '请在' || coalesce(CAST(deadline_days AS VARCHAR), '____') || '日内汇至。' || sender_name || ' ' || "
        "CASE request_id % 3 WHEN 0 THEN '2024-01-05' WHEN 1 THEN '2023-11-20' ELSE '2024-02-03' END || ' 附：' || coalesce(contract_name, '______')"
    )
    return oracle.with_(
        ("caps", capitals),
        ("rq", f"SELECT {', '.join(_pick(_REQUEST))} FROM orders"),
        ("l", f"SELECT request_id, {letter} AS letter FROM rq JOIN caps ON o_orderkey = request_id"),
    ) + "SELECT request_id, letter, sha256(base64(encode(letter))) AS base64_digest, CAST(octet_length(encode(letter)) AS INT) AS letter_bytes FROM l"


# ---- streams -----------------------------------------------------------------
def stream_views(spark: SparkSession, sf: str) -> DataFrame:
    events = stream_table(spark, sf, "events").selectExpr(*_pick(inputs.INTERACTIONS.columns))
    return jobs.count_views(events)


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that need a verdict: first seen, or seen again after the lifetime of the last one."""
    texts = stream_table(spark, sf, "events").selectExpr(
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS ts_us", "sha2(CONCAT(CAST(user_id AS STRING), props), 256) AS text_hash"
    )
    return jobs.drain(jobs.first_sightings(texts), "dedupe")


def stream_likes(spark: SparkSession, sf: str) -> DataFrame:
    events = stream_table(spark, sf, "events").selectExpr(*_pick(inputs.INTERACTIONS.columns))
    events = events.withColumn("at", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))
    return jobs.drain(jobs.guarded_marks(events, "like", "unlike"), "likes")


def stream_extract_rounds(spark: SparkSession, sf: str) -> DataFrame:
    asked = stream_table(spark, sf, "conversations").filter(inputs.ASKED.where).selectExpr(*_pick(inputs.ASKED.columns))
    return jobs.drain(jobs.every_nth_round(asked), "rounds")


_READ_KIND = "CASE WHEN value > 95 THEN 'reset' WHEN value > 50 THEN 'hit' ELSE 'miss' END"


def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Current counters of each facet of the memory, after the last reset."""
    reads = stream_table(spark, sf, "events").selectExpr(f"{memory_queries._FACET} AS facet", "event_id AS seq", f"{_READ_KIND} AS kind")
    return jobs.memory_metrics(reads)


#: files in which a log arrives, one a micro-batch
FILES = 6
_FILE = f"CAST(FLOOR(event_id * {FILES} / (SELECT max(event_id) + 1 FROM events)) AS BIGINT)"
#: some events come two files late
_LATE_FILE = f"least({_FILE} + CASE WHEN event_id % 29 = 3 THEN 2 ELSE 0 END, {FILES - 1})"


def _arriving(rows: DataFrame, name: str, text: bool = False) -> str:
    """Write ``rows`` in files one after the other, by their ``file``; a stream reads files in the order of their time."""
    path = scratch_path(rows.sparkSession, name)
    for i in range(FILES):
        part = rows.filter(F.col("file") == i).drop("file").coalesce(1).write.mode("append")
        part.text(path) if text else part.parquet(path)
    return path


def _file_of(spark: SparkSession, sf: str, expr: str) -> str:
    """The file's expression with the table's highest number in it."""
    highest = read_table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0
    return expr.replace("(SELECT max(event_id) + 1 FROM events)", str(highest + 1))


def stream_view_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Views per post and six hours of event time; events that come after their window has closed are counted apart."""
    views = inputs.INTERACTIONS.columns
    rows = read_table(spark, sf, "events").filter("event_type = 'view'")
    rows = rows.selectExpr(f"{views['post_id']} AS post_id", "CAST(ts AS TIMESTAMP) AS at", f"{_file_of(spark, sf, _LATE_FILE)} AS file")
    path = _arriving(rows, "view-files")
    stream = spark.readStream.schema("post_id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    done = jobs.windowed_views(stream, 21600, 86400)
    return done.select("post_id", F.unix_seconds("window_start").alias("start_sec"), "views", "late", "closed")


def stream_chat_log(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a chat log that arrives in several files, their chunks gathered until the end mark."""
    log = jobs.read_chat_log(spark, _chat_files(spark, sf))
    whole = jobs.drain(jobs.chat_messages(log, 10 * 86400), "chat-messages")
    return whole.select("message_id", "part", "chunks", "suggestions", F.sha2("text", 256).alias("digest"), "complete")


def stream_chat_malformed(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the chat log that cannot be read."""
    bad = jobs.drain(jobs.malformed_lines(jobs.read_chat_log(spark, _chat_files(spark, sf))), "chat-malformed")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


_CHAT_FORM = "CASE WHEN event_id % 41 = 7 THEN CONCAT('?', CAST(event_id AS STRING)) ELSE CONCAT(CAST({m} AS STRING), CHR(9), CAST(event_id AS STRING), CHR(9), CAST({t} AS STRING), CHR(9), {l}) END"


def _chat_files(spark: SparkSession, sf: str) -> str:
    line = _CHAT_FORM.format(m=_MESSAGE, t="unix_seconds(CAST(ts AS TIMESTAMP))", l=_LINE)
    return _arriving(read_table(spark, sf, "events").selectExpr(f"{line} AS value", f"{_file_of(spark, sf, _FILE)} AS file"), "chat-files", text=True)


def stream_session_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Memories that ended: their sessions paused for the lifetime, by the event time of the whole stream."""
    turns = inputs.ASKED.frame(spark, sf).selectExpr(
        "question_id", "session_id", "turn", "ts_sec", "text", *memory_queries._MODEL,
        "array(CONCAT('民法典-第', CAST(question_id % 500 AS STRING), '条'), CONCAT('c', CAST(turn AS STRING))) AS clause_ids",
    )
    least, most = turns.agg(F.min("ts_sec"), F.max("ts_sec") + 1).first()
    filed = turns.withColumn("file", F.floor((F.col("ts_sec") - (least or 0)) * FILES / ((most or 1) - (least or 0))))
    path = _arriving(filed, "turn-files")
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(path)
    ended = jobs.drain(jobs.session_memory(stream, live=True, delay="0 seconds"), "ended-sessions")
    return ended.filter("question_id IS NULL").select("session_id", "epoch", "principal", "rate", "days", "calc_type", "previous_ids")


def stream_session_state(spark: SparkSession, sf: str) -> DataFrame:
    asked = stream_table(spark, sf, "conversations").filter(inputs.ASKED.where)
    turns = asked.selectExpr(*_pick(inputs.ASKED.columns)).selectExpr(
        "question_id", "session_id", "turn", "ts_sec", "text", *memory_queries._MODEL,
        "array(CONCAT('民法典-第', CAST(question_id % 500 AS STRING), '条'), CONCAT('c', CAST(turn AS STRING))) AS clause_ids",
    )
    return jobs.drain(jobs.session_memory(turns), "sessions").drop("session_id")


_INTER = ("inter", inputs.INTERACTIONS.sql())
_POSTS = ("posts", inputs.POSTS.sql())


def _guarded_ctes(mark: str, unmark: str, name: str) -> list[tuple[str, str]]:
    return [
        (f"{name}_e", f"SELECT event_id, user_id, post_id, action, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, post_id ORDER BY ts, event_id) AS i FROM inter WHERE action IN ('{mark}', '{unmark}')"),
        (
            f"{name}",
            f"SELECT event_id, user_id, post_id, action, i, action = '{mark}' AS accepted, CASE WHEN action = '{mark}' THEN us END AS live FROM {name}_e WHERE i = 1 UNION ALL "
            f"SELECT e.event_id, e.user_id, e.post_id, e.action, e.i, CASE WHEN e.action = '{mark}' THEN g.live IS NULL OR e.us - g.live >= 86400000000 ELSE g.live IS NOT NULL AND e.us - g.live < 86400000000 END, "
            f"CASE WHEN e.action = '{unmark}' THEN NULL WHEN g.live IS NULL OR e.us - g.live >= 86400000000 THEN e.us ELSE g.live END "
            f"FROM {name} g JOIN {name}_e e ON e.user_id = g.user_id AND e.post_id = g.post_id AND e.i = g.i + 1",
        ),
    ]


_PARTED = "'【第' || (turn + 1) || '页】' || chr(10) || text || chr(10) || chr(10)"
_SPLIT = [("contracts", inputs.CONTRACTS.sql()), *oracle.split_ctes("contracts", "contract_id")]

QUERIES = {
    "scan_text": scan_text,
    "kb_visible": kb_visible,
    "kb_visible_users": kb_visible_users,
    "kb_documents": kb_documents,
    "review_records": review_records,
    "category_children": category_children,
    "category_posts": category_posts,
    "favorite_posts": favorite_posts,
    "favorite_toggle": favorite_toggle,
    "category_tree": category_tree,
    "category_cycles": category_cycles,
    "apply_changes": apply_changes,
    "partial_update": partial_update,
    "user_upsert": user_upsert,
    "assemble_pages": assemble_pages,
    "chat_chunks": chat_chunks,
    "ingest_chunks": ingest_chunks,
    "ingest_search": ingest_search,
    "ingest_status": ingest_status,
    "risk_points": risk_points,
    "page_review": page_review,
    "clamped_counter": clamped_counter,
    "guarded_likes": guarded_likes,
    "post_stats": post_stats,
    "render_letters": render_letters,
    "complaint_letters": complaint_letters,
    "stream_views": stream_views,
    "stream_dedupe": stream_dedupe,
    "stream_likes": stream_likes,
    "stream_extract_rounds": stream_extract_rounds,
    "stream_metrics": stream_metrics,
    "stream_session_state": stream_session_state,
    "stream_view_windows": stream_view_windows,
    "stream_chat_log": stream_chat_log,
    "stream_chat_malformed": stream_chat_malformed,
    "stream_session_expiry": stream_session_expiry,
}

_REVISED = "contract_id % 10 IN (0, 1, 9)"
_STORED = (
    f"SELECT chunk_id, CAST(user_id % 4 AS VARCHAR) AS kb_id, canonical_id, CASE WHEN {_REVISED} THEN '（修订）' || content ELSE content END AS content, "
    f"CAST(CASE WHEN {_REVISED} THEN 2 ELSE 1 END AS BIGINT) AS written_at FROM blocks JOIN contracts USING (contract_id)"
)
_FAV = "SELECT user_id, post_id FROM inter WHERE action = 'favorite' AND post_id IN (SELECT id FROM posts) GROUP BY ALL HAVING count(*) % 2 = 1"
ORACLES = {
    "scan_text": "SELECT item_id, text AS content FROM benchmark",
    "kb_visible": f"SELECT * FROM (SELECT {', '.join(_pick(_KB))} FROM customer) WHERE is_deleted = 0 AND (user_id = {USER} OR type = 'public')",
    "kb_visible_users": f"SELECT CASE WHEN type = 'public' THEN NULL ELSE user_id END AS viewer_id, id, type FROM (SELECT {', '.join(_pick(_KB))} FROM customer) "
    "WHERE is_deleted = 0 AND (type = 'public' OR user_id IN (SELECT user_id FROM events))",
    "kb_documents": f"SELECT {', '.join(_pick(_DOC))} FROM orders",
    "review_records": f"SELECT id, user_id, record_name, CASE WHEN id % 3 = 0 THEN NULL ELSE '/a/' || id || '.png|/b.png' END AS urls, CASE WHEN id % 4 = 0 THEN '' ELSE '风险点1:第' || (id % 9) || '条:相关合同条款' END AS risks FROM (SELECT {', '.join(_pick(_REC))} FROM orders) WHERE status <> '0'",
    "category_children": f"SELECT parent_id, id, name, icon, sort_order FROM ({inputs.CATEGORIES_SQL})",
    "category_posts": oracle.with_(_POSTS, ("cats", inputs.CATEGORIES_SQL)) + "SELECT category_id, id, title, excerpt, cover_image FROM posts WHERE category_id IN (SELECT id FROM cats)",
    "favorite_toggle": oracle.with_(_INTER, _POSTS) + _FAV,
    "favorite_posts": oracle.with_(_INTER, _POSTS, ("fav", _FAV)) + "SELECT user_id, post_id, title, content, cover_image FROM fav JOIN posts ON posts.id = post_id",
    "category_tree": oracle.with_(("cats", inputs.CATEGORIES_SQL),
        ("tree", "SELECT id AS root_id, id, name, parent_id, 1 AS depth, CAST(id AS VARCHAR) AS path FROM cats WHERE parent_id = 0 UNION ALL SELECT t.root_id, c.id, c.name, c.parent_id, t.depth + 1, t.path || '/' || c.id FROM tree t JOIN cats c ON c.parent_id = t.id"), recursive=True) + "SELECT * FROM tree",
    "category_cycles": oracle.with_(("cats", f"SELECT id, name, parent_id FROM ({inputs.CATEGORIES_SQL}) UNION ALL {_LOOPS_SQL}"),
        ("tree", "SELECT id AS root_id, id, parent_id, 1 AS depth, [id] AS way, false AS closes FROM cats WHERE parent_id = 0 UNION ALL SELECT t.root_id, c.id, c.parent_id, t.depth + 1, list_append(t.way, c.id), list_contains(t.way, c.id) FROM tree t JOIN cats c ON c.parent_id = t.id WHERE NOT t.closes"), recursive=True)
    + "SELECT root_id, id, parent_id, depth, array_to_string(way, '/') AS path FROM tree WHERE closes",
    "apply_changes": f"SELECT id, arg_max(record_name, version) FILTER (record_name IS NOT NULL) AS record_name, arg_max(total, version) AS total, min(changed) AS create_time, max(changed) AS update_time FROM (SELECT {', '.join(_pick(_CHANGE))} FROM orders) GROUP BY id HAVING arg_max(op, version) <> 'delete'",
    "partial_update": f"SELECT c.c_custkey, coalesce(nullif(u.c_name, ''), c.c_name) AS c_name, coalesce(nullif(u.c_mktsegment, ''), c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN (SELECT {', '.join(_pick(_UPDATE))} FROM customer WHERE c_custkey % 5 <> 4) u ON u.c_custkey = c.c_custkey",
    "user_upsert": "SELECT 'u' || user_id AS open_id, 'n' || event_id AS nick_name, event_type AS avatar_url, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type <> 'error' AND value >= 20) WHERE rn = 1 AND user_id NOT IN (SELECT n_nationkey FROM nation)",
    "assemble_pages": f"SELECT conv_id AS record_id, count(*) AS pages, sha256(string_agg({_PARTED}, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "chat_chunks": f"SELECT {_MESSAGE} AS message_id, count(*) FILTER (event_type = 'click') AS suggestions, nullif(count(*) FILTER (event_type = 'view'), 0) AS chunks, sha256(string_agg('答' || event_id, '' ORDER BY event_id) FILTER (event_type = 'view')) AS digest FROM events WHERE event_type = 'view' OR (event_type = 'click' AND event_id % 4 <> 0) GROUP BY 1",
    "ingest_chunks": oracle.with_(*_SPLIT, recursive=True) + f"SELECT chunk_id, kb_id, canonical_id, content, written_at FROM ({_STORED})",
    "ingest_search": oracle.with_(*_SPLIT, ("chunks", f"SELECT * FROM ({_STORED}) WHERE NOT chunk_id LIKE 'doc%3-第2条'"),
        ("queries", f"SELECT CAST(question_id AS VARCHAR) AS query_id, CAST(user_id % 4 AS VARCHAR) AS kb_id, text FROM ({inputs.ASKED.sql()})"),
        *oracle.bm25_ctes("queries", "chunks", 5), recursive=True)
    + "SELECT query_id, chunk_id, canonical_id AS clause_id, score, rank FROM bm25 JOIN chunks USING (chunk_id)",
    "ingest_status": oracle.with_(*_SPLIT, ("n", "SELECT contract_id, CAST(count(*) AS INT) AS n FROM blocks GROUP BY contract_id"),
        ("s", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 13 = 5 THEN 'failed' WHEN o_orderkey % 11 <> 3 THEN 'done' ELSE 'pending' END AS status FROM orders"), recursive=True)
    + "SELECT doc_id, status, CASE WHEN status = 'done' THEN coalesce(n, 0) END AS chunk_count FROM s LEFT JOIN n ON contract_id = doc_id",
    "risk_points": "SELECT record_id, CAST(pos AS INT) AS pos, risk_number, chapter, original_text, risk_warning FROM (SELECT o_orderkey AS record_id, unnest(CASE o_orderkey % 6 "
    "WHEN 0 THEN [{'pos': 0, 'risk_number': 'R' || o_orderkey, 'chapter': '第一条', 'original_text': '押金', 'risk_warning': '过高'}, {'pos': 1, 'risk_number': '风险点2', 'chapter': '第二条', 'original_text': '相关合同条款', 'risk_warning': '存在潜在风险，建议仔细审查'}] "
    "WHEN 1 THEN [{'pos': 0, 'risk_number': '单' || o_orderkey, 'chapter': '未明确章节', 'original_text': '相关合同条款', 'risk_warning': '存在潜在风险，建议仔细审查'}] "
    "WHEN 4 THEN [{'pos': 0, 'risk_number': 'x', 'chapter': '未明确章节', 'original_text': '相关合同条款', 'risk_warning': '存在潜在风险，建议仔细审查'}, {'pos': 1, 'risk_number': '风险点2', 'chapter': '未明确章节', 'original_text': 'y', 'risk_warning': '存在潜在风险，建议仔细审查'}, {'pos': 2, 'risk_number': '风险点3', 'chapter': '未明确章节', 'original_text': '相关合同条款', 'risk_warning': '存在潜在风险，建议仔细审查'}] END, recursive := true) FROM orders)",
    "page_review": f"SELECT conv_id AS record_id, pages, sha256(t) AS digest, CAST(CASE WHEN length({oracle.trim('t')}) < 10 THEN NULL WHEN length(t) > 8000 THEN 8000 + {len(lx.TRUNCATION_SUFFIX)} ELSE length(t) END AS INT) AS analysed, "
    f"CAST(CASE WHEN length({oracle.trim('t')}) < 10 THEN 0 ELSE [2, 1, 0, 0, 3, 0][conv_id % 6 + 1] END AS INT) AS risk_count, "
    f"CASE WHEN length({oracle.trim('t')}) < 10 THEN '' ELSE ['R' || conv_id || '|风险点2', '单' || conv_id, '', '', 'x|风险点2|风险点3', ''][conv_id % 6 + 1] END AS numbers, '1' AS status "
    f"FROM (SELECT conv_id, count(*) AS pages, string_agg({_PARTED}, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)",
    "clamped_counter": oracle.with_(_INTER,
        ("e", "SELECT post_id, CASE WHEN action = 'like' THEN 1 ELSE -1 END AS d, row_number() OVER (PARTITION BY post_id ORDER BY ts, event_id) AS i FROM inter WHERE action IN ('like', 'unlike')"),
        ("w", "SELECT post_id, i, greatest(d, 0) AS c FROM e WHERE i = 1 UNION ALL SELECT e.post_id, e.i, greatest(w.c + e.d, 0) FROM w JOIN e ON e.post_id = w.post_id AND e.i = w.i + 1"), recursive=True)
    + "SELECT post_id, CAST(arg_max(c, i) AS BIGINT) AS counter FROM w GROUP BY post_id",
    "guarded_likes": oracle.with_(_INTER, *_guarded_ctes("like", "unlike", "g"), recursive=True) + "SELECT event_id, user_id, post_id, action, accepted FROM g",
    "post_stats": oracle.with_(_INTER, *_guarded_ctes("like", "unlike", "g"), *_guarded_ctes("favorite", "unfavorite", "f"), recursive=True)
    + "SELECT post_id, coalesce(views, 0) AS views, coalesce(likes, 0) AS likes, coalesce(favorites, 0) AS favorites FROM (SELECT post_id, count(*) FILTER (action = 'view') AS views FROM inter GROUP BY post_id) "
    "LEFT JOIN (SELECT post_id, CAST(sum(CASE WHEN action = 'like' THEN 1 ELSE -1 END) AS BIGINT) AS likes FROM g WHERE accepted GROUP BY post_id) USING (post_id) "
    "LEFT JOIN (SELECT post_id, CAST(sum(CASE WHEN action = 'favorite' THEN 1 ELSE -1 END) AS BIGINT) AS favorites FROM f WHERE accepted GROUP BY post_id) USING (post_id)",
    "complaint_letters": _complaint_sql(),
    "render_letters": _letters_sql(),
    "stream_views": oracle.with_(_INTER) + "SELECT post_id, count(*) AS views FROM inter WHERE action = 'view' GROUP BY post_id",
    "stream_dedupe": "WITH RECURSIVE e AS (SELECT sha256(CAST(user_id AS VARCHAR) || props) AS text_hash, epoch_us(ts) AS ts_us FROM events), "
    "k(text_hash, ts_us) AS (SELECT text_hash, min(ts_us) FROM e GROUP BY text_hash UNION ALL "
    "SELECT k.text_hash, min(e.ts_us) FROM k JOIN e ON e.text_hash = k.text_hash AND e.ts_us >= k.ts_us + 604800000000 GROUP BY k.text_hash, k.ts_us) SELECT text_hash, ts_us FROM k",
    "stream_likes": oracle.with_(_INTER, *_guarded_ctes("like", "unlike", "g"), recursive=True) + "SELECT event_id, user_id, post_id, action, accepted FROM g",
    "stream_extract_rounds": oracle.with_(memory_queries._A, *memory_queries._ROUND_CTES)
    + "SELECT question_id, session_id, round_no FROM n WHERE round_no % 3 = 0",
    "stream_metrics": f"WITH r AS (SELECT {memory_queries._FACET} AS facet, event_id AS seq, {_READ_KIND} AS kind FROM events), "
    "e AS (SELECT *, count(*) FILTER (kind = 'reset') OVER (PARTITION BY facet ORDER BY seq) AS epoch FROM r) "
    "SELECT facet, epoch, count(*) FILTER (kind = 'hit') AS hits, count(*) FILTER (kind = 'miss') AS misses FROM e GROUP BY facet, epoch QUALIFY epoch = max(epoch) OVER (PARTITION BY facet)",
    "stream_session_state": oracle.with_(memory_queries._A, *memory_queries._CARRY, memory_queries._ROUTED, memory_queries._PREV)
    + "SELECT question_id, epoch, principal, rate, days, calc_type, previous_ids FROM carried JOIN routed USING (question_id) JOIN prev USING (question_id)",
    # the stream drops a row in batch b when its window has ended by the watermark of the batch before
    "stream_view_windows": oracle.with_(
        ("v", f"SELECT CAST(floor(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / 20) AS BIGINT) AS post_id, epoch_us(ts) AS us, {_LATE_FILE} AS file FROM events WHERE event_type = 'view'"),
        ("w", "SELECT *, us // 21600000000 * 21600 AS start_sec, (SELECT max(us) FROM v b WHERE b.file < v.file - 1) // 1000 - 86400000 AS mark, (SELECT max(us) FROM v) // 1000 - 86400000 AS passed FROM v"),
        ("d", "SELECT *, coalesce((start_sec + 21600) * 1000 <= mark, false) AS dropped, (start_sec + 21600) * 1000 <= passed AS closed FROM w"))
    + "SELECT post_id, start_sec, count(*) FILTER (NOT dropped) AS views, count(*) FILTER (dropped) AS late, closed FROM d GROUP BY post_id, start_sec, closed",
    "stream_chat_log": oracle.with_(
        ("t", f"SELECT {_MESSAGE} AS message_id, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec, event_type AS kind FROM events WHERE event_id % 41 <> 7 AND (event_type IN ('view', 'signup') OR (event_type = 'click' AND event_id % 4 <> 0))"),
        ("p", "SELECT *, lag(kind) OVER w AS was, sec - lag(sec) OVER w AS pause FROM t WINDOW w AS (PARTITION BY message_id ORDER BY event_id)"),
        ("q", "SELECT *, CAST(sum(CASE WHEN was = 'signup' OR pause >= 864000 THEN 1 ELSE 0 END) OVER (PARTITION BY message_id ORDER BY event_id) AS BIGINT) AS part FROM p"),
        ("g", "SELECT message_id, part, count(*) FILTER (kind = 'view') AS chunks, count(*) FILTER (kind = 'click') AS suggestions, sha256(coalesce(string_agg('答' || event_id, '' ORDER BY event_id) FILTER (kind = 'view'), '')) AS digest, bool_or(kind = 'signup') AS complete FROM q GROUP BY message_id, part"))
    + "SELECT message_id, part, chunks, suggestions, digest, complete FROM g QUALIFY complete OR part < max(part) OVER (PARTITION BY message_id)",
    "stream_chat_malformed": "SELECT reason, count(*) AS lines FROM (SELECT CASE WHEN event_id % 41 = 7 THEN 'form' WHEN event_type NOT IN ('view', 'click', 'error', 'signup') AND event_id % 3 = 0 THEN 'json' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY reason",
    "stream_session_expiry": oracle.with_(memory_queries._A, *memory_queries._CARRY, memory_queries._ROUTED,
        ("ends", "SELECT session_id, epoch, max(turn) AS turn, max(ts_sec) AS last FROM ep GROUP BY session_id, epoch"),
        ("over", "SELECT * FROM ends QUALIFY epoch < max(epoch) OVER (PARTITION BY session_id) OR last + 604800 <= (SELECT max(ts_sec) FROM ep)"))
    + "SELECT session_id, c.epoch, principal, rate, days, calc_type, '民法典-第' || (c.question_id % 500) || '条、c' || turn AS previous_ids FROM over JOIN carried c USING (session_id, epoch, turn) JOIN routed USING (session_id, turn)",
}
