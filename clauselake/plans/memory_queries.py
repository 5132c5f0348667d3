"""Queries over session memory, profiles and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions import calc
from clauselake.functions import lexicons as lx
from clauselake.operators import answer, evaluate, profile, review, session
from clauselake.operators.skew import lookup_join
from clauselake.operators.triage import triage as triage_op
from clauselake.plans import inputs, oracle, review_queries, search_queries
from clauselake.runtime import cut_lineage, scratch_path
from clauselake.sources.profile_store import ProfileStore, due_signals
from clauselake.sources.tables import read_table
from clauselake.streaming import jobs

NOW = review_queries.NOW


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.TURNS.frame(spark, sf)


def _calc_turns(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.ASKED.frame(spark, sf).selectExpr("question_id", "session_id", "turn", "ts_sec", "text", *_MODEL)


_MODEL = [
    "CASE WHEN turn % 3 = 0 THEN CAST(conv_id * 100 AS DOUBLE) END AS model_principal",
    "CASE WHEN turn % 4 = 2 THEN CAST(turn AS DOUBLE) END AS model_rate",
    "CASE WHEN conv_id % 2 = 0 THEN CAST(turn + 1 AS INT) END AS model_days",
]


def carried(spark: SparkSession, sf: str) -> DataFrame:
    return session.carry_params(_calc_turns(spark, sf))


def carry_params(spark: SparkSession, sf: str) -> DataFrame:
    return carried(spark, sf).select("question_id", "epoch", "principal", "rate", "days")


def _retrievals(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.ASKED.frame(spark, sf).selectExpr(
        "question_id", "session_id", "turn", "ts_sec",
        "array(CONCAT('民法典-第', CAST(question_id % 500 AS STRING), '条'), CONCAT('c', CAST(turn AS STRING))) AS clause_ids",
    )


_IDS = "CONCAT('民法典-第', CAST(question_id % 500 AS STRING), '条') || '、' || CONCAT('c', CAST(turn AS STRING))"


def prev_citations(spark: SparkSession, sf: str) -> DataFrame:
    rolled = session.previous_citations(_retrievals(spark, sf))
    return rolled.select("question_id", F.array_join("previous_ids", "、").alias("previous_ids"))


def history_window(spark: SparkSession, sf: str) -> DataFrame:
    return session.history_window(_turns(spark, sf)).select("session_id", "turn", "role", "messages", "from_end")


def history_uncompacted(spark: SparkSession, sf: str) -> DataFrame:
    """What a session holds while its compaction fails."""
    return session.history_window(_turns(spark, sf), compacted=False).select("session_id", "turn", "messages", "from_end")


def session_text(spark: SparkSession, sf: str) -> DataFrame:
    turns = _turns(spark, sf)
    summaries = turns.filter("turn = 0").selectExpr("session_id", f"{_SUMMARY} AS summary")
    return session.history_text(_long_sessions(turns), summaries).select(
        "session_id", "messages", F.sha2("history", 256).alias("digest"), F.length("history").alias("chars")
    )


_SUMMARY = "CONCAT('摘要-', session_id)"


def _long_sessions(turns: DataFrame) -> DataFrame:
    """Two conversations of one user read as one longer session."""
    return turns.selectExpr("CONCAT('s', CAST(FLOOR(CAST(SUBSTRING(session_id, 2, 18) AS BIGINT) / 2) * 2 AS BIGINT)) AS session_id",
                            "turn * 2 + CAST(SUBSTRING(session_id, 2, 18) AS BIGINT) % 2 AS turn", "role", "content",
                            "(turn * 2 + CAST(SUBSTRING(session_id, 2, 18) AS BIGINT) % 2) * 3600 AS ts_sec")


_LONG_SQL = (
    "SELECT 's' || CAST(CAST(FLOOR(CAST(SUBSTRING(session_id, 2, 18) AS BIGINT) / 2) * 2 AS BIGINT) AS VARCHAR) AS session_id, "
    "turn * 2 + CAST(SUBSTRING(session_id, 2, 18) AS BIGINT) % 2 AS turn, role, content, (turn * 2 + CAST(SUBSTRING(session_id, 2, 18) AS BIGINT) % 2) * 3600 AS ts_sec FROM turns"
)


def session_history(spark: SparkSession, sf: str) -> DataFrame:
    rounds = _rounds(spark, sf)
    counts = rounds.groupBy("session_id").agg(F.count(F.lit(1)).alias("rounds"))
    return lookup_join(rounds, counts, ["session_id"]).select("session_id", "id", "ts_sec", "question", "answer", "rounds").orderBy("session_id", "ts_sec", "id").drop("ts_sec")


def _rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Question turns with the assistant turn that follows them."""
    turns = _turns(spark, sf)
    asked = turns.filter("role = 'user'").selectExpr("session_id", "turn AS id", "ts_sec", "content AS question", "user_id")
    replies = turns.filter("role = 'assistant'").selectExpr("session_id", "turn - 1 AS id", "content AS answer")
    return asked.join(replies, ["session_id", "id"], "left")


_ROUNDS_SQL = (
    "SELECT a.session_id, a.turn AS id, a.ts_sec, a.content AS question, b.content AS answer FROM turns a LEFT JOIN turns b "
    "ON b.session_id = a.session_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'"
)


def append_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds that arrive in two loads; the second run of the stream goes on where the first has ended."""
    rounds = _rounds(spark, sf).drop("user_id")
    arriving, path = scratch_path(spark, "arriving-rounds"), scratch_path(spark, "rounds")
    for load in ("answer IS NOT NULL", "answer IS NULL"):
        rounds.filter(load).write.mode("append").parquet(arriving)
        jobs.append_rounds(spark.readStream.schema(rounds.schema).parquet(arriving), path)
    return spark.read.schema(rounds.schema).parquet(path).select("session_id", "id", "question", "answer")


def extract_every_n(spark: SparkSession, sf: str) -> DataFrame:
    return session.every_nth_round(inputs.ASKED.frame(spark, sf)).select("question_id", "session_id", "round_no")


def latest_marker(spark: SparkSession, sf: str) -> DataFrame:
    return session.latest_marked(_turns(spark, sf)).select("session_id", "turn", "content")


_HANDOFF = "CASE turn % 3 WHEN 0 THEN CONCAT('retriever::', content) WHEN 1 THEN CONCAT('calculator::', content) ELSE content END"


def handoff_text(spark: SparkSession, sf: str) -> DataFrame:
    """The newest retrieval handed over in each session."""
    lines = _turns(spark, sf).selectExpr("session_id", "turn", f"{_HANDOFF} AS line")
    return session.latest_with_prefix(lines, ["session_id"], "turn", "retriever::")


def memory_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hits and misses per facet over all reads of a session's memory."""
    reads = read_table(spark, sf, "events").selectExpr(f"{_FACET} AS facet", "value > 50 AS hit")
    return reads.groupBy("facet").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


_FACET = "CASE event_type WHEN 'view' THEN 'history' WHEN 'click' THEN 'calcParams' WHEN 'purchase' THEN 'calcType' ELSE 'docs' END"

# ---- profiles --------------------------------------------------------------
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_SIGNALS = {
    "user_id": "user_id",
    "seq": "event_id",
    "kind": "event_type",
    "k": _K,
}


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    raw = read_table(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in _SIGNALS.items()], "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS ts_sec")
    name = "CONCAT(' 合同', CAST(k % 12 AS STRING), CASE WHEN k % 2 = 0 THEN ' ' ELSE '' END)"
    return raw.selectExpr(
        "user_id", "seq", "ts_sec",
        f"CASE WHEN kind = 'view' AND k % 3 = 0 THEN array({name}, '违约金') WHEN kind = 'view' THEN array({name}) ELSE array() END AS topics",
        "CASE WHEN kind IN ('view', 'signup') THEN array(CONCAT('旧合同', CAST(k % 4 AS STRING))) END AS contracts",
        "CASE WHEN kind = 'click' THEN map(CONCAT('键', CAST(k % 3 AS STRING)), CONCAT('值', CAST(seq AS STRING))) END AS preferences",
        "CASE WHEN kind = 'purchase' THEN array(named_struct('q', CONCAT('问题', CAST(k % 5 AS STRING)), 'clause', CONCAT('条', CAST(seq AS STRING)))) END AS freq_qa",
        "CASE WHEN kind = 'purchase' THEN array(named_struct('clause', CASE WHEN k % 4 = 0 THEN ' ' ELSE CONCAT('第', CAST(k % 4 AS STRING), '条') END, 'risk', CASE WHEN k % 3 = 0 THEN '' ELSE '利率过高' END)) END AS review_history",
        "CASE WHEN kind = 'error' THEN array(named_struct('wrong', CONCAT('错', CAST(k AS STRING)), 'right', '对')) END AS corrections",
    )


def _resets(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").filter("value > 95 AND event_type = 'signup'").selectExpr("user_id", "event_id AS reset_seq")


_RESETS_SQL = "SELECT user_id, max(event_id) AS reset_seq FROM events WHERE value > 95 AND event_type = 'signup' GROUP BY user_id"


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return profile.merge_profiles(_signals(spark, sf), _resets(spark, sf))


def profile_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The profiles of ``profile_merge``, kept in a store by loads that follow one another; one load comes twice."""
    store = ProfileStore(spark, scratch_path(spark, "profiles"), 8)
    signals, resets = _signals(spark, sf), _resets(spark, sf)
    third = (signals.agg(F.max("seq")).first()[0] or 0) // 3 + 1
    for low, high in ((0, third), (third, 2 * third), (third // 2, third), (2 * third, 3 * third)):
        store.merge(signals.filter(F.col("seq").between(low, high - 1)), resets.filter(F.col("reset_seq").between(low, high - 1)))
    return store.entries().select("user_id", "field", "seq", "pos", "key", F.coalesce("value", F.lit("")).alias("value"))


#: what the model reads out of a round
_ROUND_SIGNAL = {
    "topics": "array(CONCAT('合同', CAST(conv_id % 12 AS STRING)), '违约金')", "contracts": "CAST(NULL AS ARRAY<STRING>)",
    "preferences": "map('键', CONCAT('值', CAST(question_id AS STRING)))",
    "freq_qa": "array(named_struct('q', CONCAT('问题', CAST(turn % 5 AS STRING)), 'clause', CONCAT('条', CAST(question_id AS STRING))))",
    "review_history": "CAST(NULL AS ARRAY<STRUCT<clause: STRING, risk: STRING>>)", "corrections": "CAST(NULL AS ARRAY<STRUCT<wrong: STRING, right: STRING>>)",
}


def profile_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles refreshed at every third round of a session, in two loads of rounds."""
    rounds = inputs.ASKED.frame(spark, sf)
    signals = rounds.selectExpr("user_id", "question_id AS seq", "ts_sec", *[f"{e} AS {n}" for n, e in _ROUND_SIGNAL.items()])
    due = cut_lineage(due_signals(rounds, signals))
    store = ProfileStore(spark, scratch_path(spark, "refreshed"), 8)
    for load in ("seq % 2 = 1", "seq % 2 = 0"):
        store.merge(due.filter(load))
    return store.entries().select("user_id", "field", "seq", "pos", "key", F.coalesce("value", F.lit("")).alias("value"))


def eval_refusal_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Refusals by scope against the questions that are meant to be refused, with intervals."""
    cases = _triaged(spark, sf).selectExpr("question_id", "question_id % 6 = 0 AS should_refuse", "rejected AS refused")
    return evaluate.refusal_intervals(cases, "question_id")


def profile_merge(spark: SparkSession, sf: str) -> DataFrame:
    entries = merged(spark, sf)
    return lookup_join(entries, profile.last_active(_signals(spark, sf)), ["user_id"], "inner").select(
        "user_id", "field", "seq", "pos", "key", F.coalesce("value", F.lit("")).alias("value"), "last_active"
    )


def _entries_sql() -> str:
    name = "trim('合同' || CAST(k % 12 AS VARCHAR))"
    return oracle.with_(
        ("sig", f"SELECT user_id, event_id AS seq, event_type AS kind, {_K} AS k FROM events LEFT JOIN ({_RESETS_SQL}) r USING (user_id) WHERE reset_seq IS NULL OR event_id > reset_seq"),
        ("lng", f"SELECT user_id, seq, 'topic' AS field, 0 AS pos, {name} AS key, '' AS value FROM sig WHERE kind = 'view' "
                "UNION ALL SELECT user_id, seq, 'topic', 1, '违约金', '' FROM sig WHERE kind = 'view' AND k % 3 = 0 "
                "UNION ALL SELECT user_id, seq, 'topic', 0, '旧合同' || (k % 4), '' FROM sig WHERE kind = 'signup' "
                "UNION ALL SELECT user_id, seq, 'preference', 0, '键' || (k % 3), '值' || seq FROM sig WHERE kind = 'click' "
                "UNION ALL SELECT user_id, seq, 'faq', 0, '问题' || (k % 5), '条' || seq FROM sig WHERE kind = 'purchase' "
                "UNION ALL SELECT user_id, seq, 'review', 0, CASE WHEN k % 4 = 0 THEN '' ELSE '第' || (k % 4) || '条' END, CASE WHEN k % 3 = 0 THEN '' ELSE '利率过高' END FROM sig WHERE kind = 'purchase' AND NOT (k % 4 = 0 AND k % 3 = 0) "
                "UNION ALL SELECT user_id, seq, 'correction', 0, '错' || k, '对' FROM sig WHERE kind = 'error'"),
        ("rk", "SELECT *, row_number() OVER (PARTITION BY user_id, field, key, CASE WHEN field = 'review' THEN value END ORDER BY seq, pos) AS a, "
               "row_number() OVER (PARTITION BY user_id, field, key ORDER BY seq DESC, pos DESC) AS z FROM lng"),
        ("entries", "SELECT user_id, field, seq, pos, key, value FROM rk WHERE field = 'correction' OR (field = 'preference' AND z = 1) OR (field IN ('topic', 'faq', 'review') AND a = 1)"),
    )


def recalled(spark: SparkSession, sf: str) -> DataFrame:
    questions = inputs.ASKED.frame(spark, sf).select("question_id", "user_id", "text")
    return profile.recall_profiles(questions, cut_lineage(merged(spark, sf)))


def profile_recall(spark: SparkSession, sf: str) -> DataFrame:
    return recalled(spark, sf)


def _recall_ctes() -> list[tuple[str, str]]:
    letters = r"regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]', '', 'g')"
    grams = "list_distinct(list_transform(range(1, length(l)), lambda i: substring(l, i, 2)))"
    return [
        ("pieces", "SELECT user_id, 0 AS ord, 0 AS seq, 0 AS pos, '已咨询领域：' || string_agg(key, '、' ORDER BY seq, pos) AS piece FROM entries WHERE field = 'topic' GROUP BY user_id "
                   "UNION ALL SELECT user_id, 1, 0, 0, '偏好：{' || string_agg(key || '=' || value, ', ' ORDER BY key) || '}' FROM entries WHERE field = 'preference' GROUP BY user_id "
                   "UNION ALL SELECT user_id, 2, seq, pos, '高频关注：' || key || '（' || value || '）' FROM entries WHERE field = 'faq' "
                   "UNION ALL SELECT user_id, 3, seq, pos, '审查过的条款：' || key || '（风险：' || value || '）' FROM entries WHERE field = 'review' "
                   "UNION ALL SELECT user_id, 4, seq, pos, '纠错：' || key || '→' || value FROM entries WHERE field = 'correction'"),
        ("qg", f"SELECT question_id, user_id, {grams} AS g FROM (SELECT question_id, user_id, {letters.format('text')} AS l FROM ({inputs.ASKED.sql()}))"),
        ("pg", f"SELECT *, {grams} AS g FROM (SELECT *, {letters.format('piece')} AS l FROM pieces)"),
        ("hitp", "SELECT question_id, ord, seq, pos, piece, len(list_intersect(qg.g, pg.g)) AS ov FROM qg JOIN pg USING (user_id) WHERE len(list_intersect(qg.g, pg.g)) > 0"),
        ("recalled", "SELECT question_id, substring(string_agg(piece, '；' ORDER BY ord, seq, pos, piece), 1, 500) AS profile_text "
                     "FROM hitp GROUP BY question_id"),
    ]


# ---- answers ---------------------------------------------------------------
def _triaged(spark: SparkSession, sf: str) -> DataFrame:
    asked = inputs.ASKED.frame(spark, sf).withColumn("has_history", F.col("turn") > 1)
    raw = asked.select("text").distinct().selectExpr(
        "sha2(text, 256) AS text_hash", f"{review_queries._SCOPE_RAW} AS scope_raw", f"{review_queries._INTENT_RAW} AS intent_raw"
    )
    return triage_op(asked, raw).selectExpr("question_id", "rejected", "intent", "CASE WHEN rejected THEN '超出范围' END AS scope_reply")


def _calculated(spark: SparkSession, sf: str, triaged: DataFrame) -> DataFrame:
    """Amounts of the calculating turns; only these turns store and hand on parameters."""
    c = F.col
    turns = _calc_turns(spark, sf).join(triaged.filter("intent IN ('both', 'calculate')").select("question_id"), "question_id", "left_semi")
    routed = session.route_turns(turns).select("question_id", "calc_type")
    rows = session.carry_params(turns).join(routed, "question_id").withColumn("majeure", c("text").contains("不可抗力"))
    amount = calc.compute_amount(c("calc_type"), c("principal"), c("rate"), c("days"), c("majeure"), c("text"))
    return rows.select("question_id", "session_id", "turn", "calc_type", "principal", "rate", "days", amount.alias("amount"))


_PROSE = "CASE question_id % 6 WHEN 0 THEN '知识库里没检索到，无法作答。' WHEN 1 THEN '' ELSE CONCAT('依据片段[1]，答复', CAST(question_id AS STRING)) END"
_PROSE_AGAIN = "CASE question_id % 5 WHEN 0 THEN '未检索到相关内容' ELSE CONCAT('重新检索后的答复', CAST(question_id AS STRING)) END"


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """The whole batch: scope first, retrieval and calculation only where they are due, the critic, one new plan."""
    triaged = cut_lineage(_triaged(spark, sf))
    due = triaged.filter("NOT rejected AND (intent IS NULL OR intent <> 'review')").select("question_id")
    asked = inputs.asked(spark, sf).join(due, "question_id", "left_semi")
    hits = cut_lineage(answer.gated_retrieval(asked, inputs.statutes(spark, sf), search_queries.grader, search_queries.rewrites(spark, sf)))
    ids = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "clause_id"))).alias("h"))
    retrievals = asked.select("question_id", "session_id", "turn", "ts_sec").join(ids, "question_id", "left")
    retrievals = retrievals.withColumn("clause_ids", F.coalesce("h.clause_id", F.array().cast("array<string>"))).drop("h")
    previous = session.previous_citations(retrievals).select("question_id", "previous_ids")
    said = asked.select("question_id")
    proses = said.selectExpr("question_id", "0 AS attempt", f"{_PROSE} AS prose").unionByName(
        said.selectExpr("question_id", "1 AS attempt", f"{_PROSE_AGAIN} AS prose"))
    judgements = said.selectExpr("question_id", "0 AS attempt", f"{_CRITIC_RAW} AS raw")
    return answer.answer_batch(
        triaged, hits, proses, judgements, _calculated(spark, sf, triaged), previous, recalled(spark, sf), _reports(spark, sf, triaged)
    )


def _reports(spark: SparkSession, sf: str, triaged: DataFrame) -> DataFrame:
    """Reports of the contracts that the review questions bring along."""
    orders = read_table(spark, sf, "orders").count()
    wanted = triaged.filter("intent = 'review'").selectExpr("question_id", f"question_id % {orders} AS contract_id")
    contracts = inputs.CONTRACTS.frame(spark, sf).join(wanted.select("contract_id").distinct(), "contract_id", "left_semi")
    items = review_queries.reviewed(spark, sf, contracts)
    return review.review_report(items, contracts).join(wanted, "contract_id").select("question_id", "report")


def answer_compose(spark: SparkSession, sf: str) -> DataFrame:
    return answered(spark, sf).select(
        "question_id", "rejected", "intent", "amount", F.sha2("answer", 256).alias("digest"), F.substring("answer", 1, 40).alias("head")
    )


_CRITIC_RAW = "CASE question_id % 4 WHEN 0 THEN 'YES 充分' WHEN 1 THEN ' no, 缺依据' WHEN 2 THEN '依据不足' ELSE NULL END"


def critic_flag(spark: SparkSession, sf: str) -> DataFrame:
    questions = inputs.QUESTIONS.frame(spark, sf).selectExpr(
        "question_id", "CASE WHEN question_id % 10 = 3 THEN 'review' ELSE 'both' END AS intent",
        "CASE question_id % 7 WHEN 0 THEN '（检索失败）' WHEN 1 THEN ' ' ELSE text END AS answer",
        f"{_CRITIC_RAW} AS raw", "CAST(question_id % 2 AS INT) AS retries",
    )
    return answer.critic(questions).select("question_id", "needs_more", "retries_after")


def answer_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and flags an evaluation reads next to each answer."""
    return answered(spark, sf).select(
        "question_id", "retrieved", "graded", "principal", "rate", "days", "amount", "rejected", "replanned"
    )


def session_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    turns = _turns(spark, sf)
    history = session.history_text(turns).selectExpr("session_id", "messages", "sha2(history, 256) AS history_digest")
    kept = _calculated(spark, sf, _triaged(spark, sf)).groupBy("session_id").agg(
        F.max_by(F.struct("principal", "rate", "days", "calc_type"), "turn").alias("p")
    )
    cited = session.previous_citations(_retrievals(spark, sf)).groupBy("session_id").agg(
        F.max_by(F.coalesce(F.array_join("previous_ids", "、"), F.lit("")), "turn").alias("previous_ids")
    )
    owner = turns.groupBy("session_id").agg(F.max("user_id").alias("user_id"))
    entries = merged(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("profile_entries"))
    return (
        owner.join(history, "session_id", "left").join(kept, "session_id", "left")
        .join(cited, "session_id", "left").join(entries, "user_id", "left")
        .select("session_id", "user_id", "messages", "history_digest", "p.principal", "p.rate", "p.days", "p.calc_type", "previous_ids",
                F.coalesce("profile_entries", F.lit(0)).alias("profile_entries"))
    )


def eval_refusal(spark: SparkSession, sf: str) -> DataFrame:
    """Refusals of the engine's own answers against the questions that are meant to be refused."""
    cases = answered(spark, sf).selectExpr("question_id % 6 = 0 AS should_refuse", "rejected AS refused")
    return evaluate.refusal_rates(cases)


def eval_amount(spark: SparkSession, sf: str) -> DataFrame:
    from clauselake.plans.calc_queries import extracted

    expected = read_table(spark, sf, "orders").selectExpr(
        "o_orderkey AS question_id", "CAST(FLOOR(o_totalprice) AS DOUBLE) AS expected_principal",
        "CAST(o_orderkey % 90 + 1 AS INT) AS expected_days", "0.5D AS expected_rate_per_mille",
    )
    return evaluate.amount_accuracy(extracted(spark, sf).join(expected, "question_id"), ["principal", "days", "rate_per_mille"])


# ---- oracle ----------------------------------------------------------------
_T = ("turns", inputs.TURNS.sql())
_A = ("asked", inputs.ASKED.sql())
_ROUND_CTES = [
    ("g", "SELECT *, CASE WHEN ts_sec - lag(ts_sec) OVER (PARTITION BY session_id ORDER BY turn) >= 2592000 THEN 1 ELSE 0 END AS gap FROM asked"),
    ("l", "SELECT *, sum(gap) OVER (PARTITION BY session_id ORDER BY turn) AS life FROM g"),
    ("n", "SELECT *, row_number() OVER (PARTITION BY session_id, life ORDER BY turn) AS round_no FROM l"),
]
_CARRY = [
    ("ct", f"SELECT question_id, session_id, turn, ts_sec, text, {', '.join(_MODEL)} FROM asked"),
    *oracle.params_ctes("ct", "question_id"),
    ("ep0", "SELECT *, CASE WHEN ts_sec - lag(ts_sec) OVER (PARTITION BY session_id ORDER BY turn) >= 604800 THEN 1 ELSE 0 END AS gap FROM ct"),
    ("ep", "SELECT *, CAST(sum(gap) OVER (PARTITION BY session_id ORDER BY turn) AS BIGINT) AS epoch FROM ep0"),
    ("carried", "SELECT question_id, session_id, turn, e.text, epoch, "
     + ", ".join(
         f"coalesce(last_value({r} IGNORE NULLS) OVER w, first_value({m} IGNORE NULLS) OVER w) AS {n}"
         for n, r, m in [("principal", "p.principal", "model_principal"), ("rate", "p.rate_per_mille", "model_rate"), ("days", "p.days", "model_days")]
     )
     + " FROM ep e JOIN params p USING (question_id) WINDOW w AS (PARTITION BY session_id, epoch ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
]
_ROUTED = (
    "routed",
    "SELECT question_id, session_id, turn, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY session_id, epoch ORDER BY turn ROWS UNBOUNDED PRECEDING), 'PENALTY') AS calc_type "
    f"FROM (SELECT *, {oracle.explicit_type('text')} AS x FROM ep)",
)
_AMOUNTED = (
    "amounted",
    f"SELECT question_id, principal, rate, days, {oracle.amount('calc_type', 'principal', 'rate', 'days', '''contains(text, '不可抗力')''', 'text')} AS amount FROM carried JOIN routed USING (question_id)",
)
_PREV = (
    "prev",
    f"SELECT question_id, session_id, turn, CASE WHEN ts_sec - lag(ts_sec) OVER w < 604800 THEN lag({_IDS}) OVER w END AS previous_ids FROM asked WINDOW w AS (PARTITION BY session_id ORDER BY turn)",
)
_LIFE = (
    "SELECT * FROM (SELECT *, sum(gap) OVER (PARTITION BY session_id ORDER BY turn) AS life FROM (SELECT *, "
    "CASE WHEN ts_sec - lag(ts_sec) OVER (PARTITION BY session_id ORDER BY turn) >= 604800 THEN 1 ELSE 0 END AS gap FROM {0} WHERE trim(content) <> '')) "
    "QUALIFY life = max(life) OVER (PARTITION BY session_id)"
)
_RETAIN = f"SELECT *, count(*) OVER (PARTITION BY session_id) AS messages, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS INT) AS from_end FROM ({_LIFE})"
_KEEP = "from_end <= CASE WHEN messages <= 8 THEN messages ELSE 8 + messages % 2 END"
_LINES = "string_agg(CASE WHEN role = 'user' THEN '用户：' ELSE '助手：' END || content, chr(10) ORDER BY turn)"
_TRI = (
    "tri",
    f"SELECT question_id, rejected, intent FROM ({review_queries.triage_sql('(SELECT *, turn > 1 AS has_history FROM asked)')})",
)


#: the carry over calculating turns alone
_CALC_CARRY = [(n, q.replace(" FROM asked", " FROM asked WHERE question_id IN (SELECT question_id FROM tri WHERE intent IN ('both', 'calculate'))")) if n == "ct" else (n, q) for n, q in _CARRY]


def _batch_ctes() -> list[tuple[str, str]]:
    """CTEs ending in ``final`` (``question_id, intent, rejected, amount, principal, rate, days, answer, retrieved, graded, replanned``)."""
    amount = "'【计算结论】本金 ' || coalesce({p}, 'null') || ' 元，日利率 ' || coalesce({r}, 'null') || '‰，' || coalesce(CAST(days AS VARCHAR), 'null') || ' 天，金额 = ' || format('{{:.2f}}', amount) || ' 元。' || chr(10)"
    amount = amount.format(p=oracle.java_double("principal"), r=oracle.java_double("rate"))

    def attempt(n: int, prose: str, before: str, reply: str, source: str) -> list[tuple[str, str]]:
        nl = "chr(10)"
        return [
            (f"t{n}", f"SELECT q.*, CASE WHEN retrieved IS NULL THEN '{lx.REJECT_ANSWER}' ELSE {prose} END AS said, {before} AS before, {reply} AS reply FROM {source}"),
            (f"u{n}", f"SELECT *, rejected_scope OR (retrieves AND coalesce(regexp_matches(said, '无法作答|未检索到'), false)) AS rejected, CASE WHEN retrieves THEN CASE WHEN trim(coalesce(said, '')) = '' THEN '{lx.NOTHING_TO_CITE}' ELSE said END END AS prose FROM t{n}"),
            (f"v{n}", f"SELECT *, trim(coalesce('（延续上轮引用条款：' || nullif(before, '') || '）' || {nl} || {nl}, '') || coalesce(prose || {nl} || {nl}, '') || coalesce('【引用依据】' || {nl} || cites || {nl}, '') || "
                      f"CASE WHEN amount IS NOT NULL THEN {amount} ELSE '' END || coalesce({nl} || '【结合您的长期画像】' || nullif(profile_text, '') || {nl}, ''), {oracle.BLANKS}) AS body FROM u{n}"),
            (f"w{n}", f"SELECT *, CASE WHEN rejected THEN coalesce(reply, '{lx.OUT_OF_SCOPE_FALLBACK}') WHEN report IS NOT NULL THEN {oracle.trim('report')} WHEN body = '' THEN '（未能生成答复）' ELSE body END AS answer FROM v{n}"),
        ]

    verdict = f"upper(trim(coalesce({_CRITIC_RAW}, '')))"
    bad = f"(trim(answer) = '' OR regexp_matches(answer, '（检索失败）|（综合失败）|（计算失败）') OR starts_with({verdict}, 'NO') OR contains({verdict}, '不足') OR contains({verdict}, '不充分'))"
    return [
        _A, _TRI, *_CALC_CARRY, _ROUTED, _AMOUNTED, *_split_entries(), *_recall_ctes(), *search_queries.gated_ctes(),
        ("due", "SELECT question_id, session_id, turn, ts_sec FROM asked JOIN tri USING (question_id) WHERE NOT rejected AND coalesce(intent, '') <> 'review'"),
        ("own", "SELECT question_id, count(*) AS retrieved, count(*) FILTER (kept) AS graded, string_agg(clause_id, '、' ORDER BY rank) AS ids, "
                "string_agg('· ' || clause_id || '：' || content || chr(10), '' ORDER BY rank) AS cites FROM gated WHERE question_id IN (SELECT question_id FROM due) GROUP BY question_id"),
        ("prev", "SELECT question_id, CASE WHEN ts_sec - lag(ts_sec) OVER w < 604800 THEN lag(ids) OVER w END AS previous_ids FROM due LEFT JOIN own USING (question_id) WINDOW w AS (PARTITION BY session_id ORDER BY turn)"),
        ("reports", oracle.with_(*review_queries.review_ctes(), recursive=True) + f"SELECT contract_id, {review_queries.REPORT_SQL} AS report FROM contracts LEFT JOIN (SELECT contract_id, count(*) AS n, count(*) FILTER (risky) AS r, string_agg({review_queries._REPORT_BODY}, '' ORDER BY pos) AS body FROM items GROUP BY contract_id) USING (contract_id)"),
        ("base", "SELECT t.question_id, t.intent, t.rejected AS rejected_scope, CASE WHEN t.rejected THEN '超出范围' END AS scope_reply, NOT t.rejected AND coalesce(t.intent, '') <> 'review' AS retrieves, "
                 "CASE WHEN t.intent = 'review' THEN report END AS report, retrieved, graded, ids, cites, previous_ids, profile_text, principal, rate, days, amount "
                 "FROM tri t LEFT JOIN own USING (question_id) LEFT JOIN prev USING (question_id) LEFT JOIN recalled USING (question_id) LEFT JOIN amounted USING (question_id) "
                 "LEFT JOIN reports ON t.intent = 'review' AND contract_id = t.question_id % (SELECT count(*) FROM orders)"),
        *attempt(0, _PROSE, "previous_ids", "scope_reply", "base q"),
        ("again", f"SELECT question_id, answer AS earlier FROM w0 WHERE NOT rejected_scope AND coalesce(intent, '') <> 'review' AND {bad}"),
        *attempt(1, _PROSE_AGAIN, "ids", "earlier", "base q JOIN again USING (question_id)"),
        ("final", "SELECT question_id, intent, rejected, CASE WHEN NOT rejected_scope THEN amount END AS amount, principal, rate, days, answer, coalesce(retrieved, 0) AS retrieved, coalesce(graded, 0) AS graded, replanned FROM "
                  "(SELECT *, false AS replanned FROM w0 WHERE question_id NOT IN (SELECT question_id FROM again) UNION ALL BY NAME SELECT *, true AS replanned FROM w1)"),
    ]


def _split_entries() -> list[tuple[str, str]]:
    """The CTEs of ``_entries_sql`` as (name, sql) pairs."""
    text = _entries_sql()[len("WITH "):].strip()
    out, depth, start, name = [], 0, 0, ""
    for i, ch in enumerate(text):
        if ch == "(":
            if depth == 0:
                name, begin = text[start:i].replace(" AS ", "").strip(" ,"), i + 1
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                out.append((name, text[begin:i]))
                start = i + 1
    return out


QUERIES = {
    "carry_params": carry_params,
    "prev_citations": prev_citations,
    "history_window": history_window,
    "history_uncompacted": history_uncompacted,
    "session_text": session_text,
    "session_history": session_history,
    "append_rounds": append_rounds,
    "extract_every_n": extract_every_n,
    "latest_marker": latest_marker,
    "handoff_text": handoff_text,
    "memory_metrics": memory_metrics,
    "profile_merge": profile_merge,
    "profile_recall": profile_recall,
    "answer_compose": answer_compose,
    "critic_flag": critic_flag,
    "answer_meta": answer_meta,
    "session_snapshot": session_snapshot,
    "eval_refusal": eval_refusal,
    "eval_refusal_intervals": eval_refusal_intervals,
    "profile_incremental": profile_incremental,
    "profile_refresh": profile_refresh,
    "eval_amount": eval_amount,
}

ORACLES = {
    "carry_params": oracle.with_(_A, *_CARRY) + "SELECT question_id, epoch, principal, rate, days FROM carried",
    "prev_citations": oracle.with_(_A, _PREV) + "SELECT question_id, previous_ids FROM prev",
    "history_window": oracle.with_(_T, ("r", _RETAIN.format("turns"))) + f"SELECT session_id, turn, role, messages, from_end FROM r WHERE {_KEEP}",
    "history_uncompacted": oracle.with_(_T, ("r", _RETAIN.format("turns"))) + "SELECT session_id, turn, messages, from_end FROM r WHERE from_end <= 20",
    "session_text": oracle.with_(_T, ("lt", _LONG_SQL), ("r", _RETAIN.format("lt")),
        ("b", f"SELECT session_id, max(messages) AS messages, {_LINES} AS body FROM r WHERE {_KEEP} GROUP BY session_id"),
        ("h", f"SELECT session_id, messages, CASE WHEN messages > 9 AND s.summary IS NOT NULL THEN '【历史摘要（更早轮次经 LLM 压缩所得，含关键约束与条款编号）】' || chr(10) || s.summary || chr(10) || chr(10) || body ELSE body END AS history FROM b LEFT JOIN (SELECT session_id, {_SUMMARY} AS summary FROM turns WHERE turn = 0) s USING (session_id)"))
    + "SELECT session_id, messages, sha256(history) AS digest, CAST(length(history) AS INT) AS chars FROM h",
    "session_history": oracle.with_(_T, ("r", _ROUNDS_SQL)) + "SELECT session_id, id, question, answer, count(*) OVER (PARTITION BY session_id) AS rounds FROM r",
    "append_rounds": oracle.with_(_T, ("r", _ROUNDS_SQL)) + "SELECT session_id, id, question, answer FROM r",
    "extract_every_n": oracle.with_(_A, *_ROUND_CTES) + "SELECT question_id, session_id, round_no FROM n WHERE round_no % 3 = 0",
    "latest_marker": oracle.with_(_T) + "SELECT session_id, turn, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM turns WHERE contains(content, '【已审查条款】')) WHERE rn = 1",
    "handoff_text": oracle.with_(_T) + f"SELECT session_id, substring(line, 12) AS line FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM (SELECT session_id, turn, {_HANDOFF} AS line FROM turns) WHERE starts_with(line, 'retriever::')) WHERE rn = 1",
    "memory_metrics": f"SELECT {_FACET} AS facet, count(*) FILTER (value > 50) AS hits, count(*) FILTER (NOT value > 50) AS misses FROM events GROUP BY 1",
    "profile_merge": _entries_sql() + "SELECT user_id, field, seq, pos, key, value, last_active FROM entries JOIN (SELECT user_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_active FROM events GROUP BY user_id) USING (user_id)",
    "profile_recall": _entries_sql() + ", " + ", ".join(f"{n} AS ({q})" for n, q in _recall_ctes()) + " SELECT question_id, profile_text FROM recalled",
    "answer_compose": oracle.with_(*_batch_ctes(), recursive=True)
    + "SELECT question_id, rejected, intent, amount, sha256(answer) AS digest, substring(answer, 1, 40) AS head FROM final",
    "critic_flag": oracle.with_(("q", inputs.QUESTIONS.sql()),
        ("a", f"SELECT question_id, question_id % 10 = 3 AS rev, CASE question_id % 7 WHEN 0 THEN '（检索失败）' WHEN 1 THEN ' ' ELSE text END AS answer, upper(trim(coalesce({_CRITIC_RAW}, ''))) AS raw, question_id % 2 AS retries FROM q"),
        ("b", "SELECT *, NOT rev AND retries < 1 AND (trim(answer) = '' OR regexp_matches(answer, '（检索失败）|（综合失败）|（计算失败）') OR starts_with(raw, 'NO') OR contains(raw, '不足') OR contains(raw, '不充分')) AS needs_more FROM a"))
    + "SELECT question_id, needs_more, CAST(retries + CASE WHEN needs_more THEN 1 ELSE 0 END AS INT) AS retries_after FROM b",
    "answer_meta": oracle.with_(*_batch_ctes(), recursive=True)
    + "SELECT question_id, retrieved, graded, principal, rate, days, amount, rejected, replanned FROM final",
    "session_snapshot": _entries_sql() + ", " + oracle.with_(_T, _A, _TRI, *_CALC_CARRY, _ROUTED, _PREV, ("r", _RETAIN.format("turns")),
        ("hist", f"SELECT session_id, max(messages) AS messages, sha256({_LINES}) AS history_digest FROM r WHERE {_KEEP} GROUP BY session_id"),
        ("lastc", "SELECT session_id, principal, rate, days FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM carried) WHERE rn = 1"),
        ("lastt", "SELECT session_id, calc_type FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM routed) WHERE rn = 1"),
        ("lastp", "SELECT session_id, coalesce(previous_ids, '') AS previous_ids FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM prev) WHERE rn = 1"),
        ("own", "SELECT session_id, max(user_id) AS user_id FROM turns GROUP BY session_id"),
        ("ne", "SELECT user_id, count(*) AS profile_entries FROM entries GROUP BY user_id"))[len("WITH "):]
    + "SELECT session_id, user_id, messages, history_digest, principal, rate, days, calc_type, previous_ids, coalesce(profile_entries, 0) AS profile_entries FROM own LEFT JOIN hist USING (session_id) LEFT JOIN lastc USING (session_id) LEFT JOIN lastt USING (session_id) LEFT JOIN lastp USING (session_id) LEFT JOIN ne USING (user_id)",
    "eval_refusal": oracle.with_(*_batch_ctes(), ("c", "SELECT question_id % 6 = 0 AS should, rejected FROM final"), recursive=True)
    + "SELECT tp, fn, fp, tn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall FROM (SELECT count(*) FILTER (should AND rejected) AS tp, count(*) FILTER (should AND NOT rejected) AS fn, "
    "count(*) FILTER (NOT should AND rejected) AS fp, count(*) FILTER (NOT should AND NOT rejected) AS tn FROM c)",
    "eval_amount": oracle.with_(("questions", inputs.QUESTIONS.sql()), *oracle.params_ctes("questions", "question_id"))
    + "SELECT count(*) AS cases, round(avg(CASE WHEN principal IS NOT DISTINCT FROM floor(o_totalprice) THEN 1.0::DOUBLE ELSE 0 END), 6) AS principal_accuracy, round(avg(CASE WHEN days IS NOT DISTINCT FROM o_orderkey % 90 + 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS days_accuracy, "
    "round(avg(CASE WHEN rate_per_mille IS NOT DISTINCT FROM 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate_per_mille_accuracy FROM params JOIN orders ON question_id = o_orderkey",
    "eval_refusal_intervals": oracle.with_(_A, _TRI,
        ("cases", "SELECT question_id AS case_id, CAST(question_id % 6 = 0 AS INT) AS w, CAST(rejected AS INT) AS r, w * r AS hit FROM tri"),
        *oracle.bootstrap_ctes("cases", {"precision": ("hit", "r"), "recall": ("hit", "w")})) + "SELECT * FROM intervals",
    "profile_incremental": _entries_sql() + "SELECT user_id, field, seq, pos, key, value FROM entries",
    "profile_refresh": oracle.with_(_A, *_ROUND_CTES,
        ("due", "SELECT * FROM n WHERE round_no % 3 = 0"),
        ("lng", "SELECT user_id, question_id AS seq, 'topic' AS field, 0 AS pos, '合同' || (conv_id % 12) AS key, '' AS value FROM due UNION ALL SELECT user_id, question_id, 'topic', 1, '违约金', '' FROM due "
                "UNION ALL SELECT user_id, question_id, 'preference', 0, '键', '值' || question_id FROM due UNION ALL SELECT user_id, question_id, 'faq', 0, '问题' || (turn % 5), '条' || question_id FROM due"),
        ("rk", "SELECT *, row_number() OVER (PARTITION BY user_id, field, key ORDER BY seq, pos) AS a, row_number() OVER (PARTITION BY user_id, field, key ORDER BY seq DESC) AS z FROM lng"))
    + "SELECT user_id, field, seq, pos, key, value FROM rk WHERE CASE field WHEN 'preference' THEN z ELSE a END = 1",
}
