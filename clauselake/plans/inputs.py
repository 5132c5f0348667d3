"""Domain tables derived from the given tables.

The given tables hold no Chinese legal text, so questions, contracts, statutes
and session data are spelled out from their rows.  Each definition is a list of
plain SQL expressions that Spark and the oracle database read alike; it is an
input, not an operator.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from clauselake.runtime import spread
from clauselake.sources.tables import read_table


@dataclass(frozen=True)
class Derived:
    table: str
    columns: dict[str, str]
    where: str | None = None

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        df = read_table(spark, folder, self.table)
        if self.where:
            df = df.filter(self.where)
        df = spread(df)
        return df.selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    def sql(self) -> str:
        cols = ", ".join(f"{e} AS {n}" for n, e in self.columns.items())
        return f"SELECT {cols} FROM {self.table}" + (f" WHERE {self.where}" if self.where else "")


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _cat(*parts: str) -> str:
    return "CONCAT(" + ", ".join(parts) + ")"


def _cases(selector: str, options: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options[:-1]))
    return f"CASE {selector} {arms} ELSE {options[-1]} END"


def _question_options(price: str, days: str) -> list[str]:
    """Sixteen kinds of questions around an amount and a day count."""
    p, d = _s(price), _s(days)
    wan = _s(f"CAST(FLOOR({price} / 10000) AS BIGINT)")
    return [
        _cat("'本金'", p, "'元逾期'", d, "'天，利率万分之五，违约金多少'"),
        _cat(wan, "'万货款逾期'", _s(f"({days}) % 12 + 1"), "'个月违约金怎么算'"),
        _cat("'货款'", p, "'元逾期两个月'"),
        _cat("'借款'", wan, "'万，利率'", _s(f"({days}) % 20"), "'%，'", d, "'天，利息多少'"),
        _cat("'因不可抗力逾期'", d, "'天，欠款'", wan, "'万'"),
        _cat("'定金'", d, "'万，货款'", p, "'元逾期半年，日利率千分之一'"),
        _cat("'欠款'", p, "'元，没逾期'"),
        _cat("'改成'", d, "'天呢'"),
        "'请审查这份合同有没有问题'",
        "'商标侵权怎么赔'",
        "'这个条款怎么理解'",
        _cat("'借了'", p, "'元，千分之5，'", _s(f"({days}) % 5 + 1"), "'年，如果'"),
        _cat(
            "'押金'", d, "'元，另按约定支付其余款项若干作为本次交易的对价，'", "'违约金按日万分之三计，应付房款'", d,
            "'.5万逾期'", d, "'天，此外双方还约定其他事项若干条不再赘述，保证金1亿'",
        ),
        "'合同什么时候生效'",
        "'那离婚财产怎么分'",
        _cat("'how long is item '", d),
    ]


_PRICE = "CAST(FLOOR(o_totalprice) AS BIGINT)"
_DAYS = "(o_orderkey % 90 + 1)"

QUESTIONS = Derived(
    "orders",
    {
        "question_id": "o_orderkey",
        "session_id": _cat("'s'", _s("o_custkey")),
        "user_id": "o_custkey",
        "turn": "o_orderkey",
        "text": _cases("o_orderkey % 16", _question_options(_PRICE, _DAYS)),
    },
)

_CN_SHARE = _cases("o_orderkey % 6", ["'五'", "'十'", "'二十'", "'三十五'", "'五十'", "'45'"])
_A, _B = _s("o_orderkey % 23 + 1"), _s("o_orderkey % 11 + 1")
_CLAUSE_1 = _cat("'第一条 甲方应按约定向乙方交付货物'", _B, "'台，交付时间为签约之日起'", _A, "'日内。'")
_CLAUSE_2 = _cat("'第二条　乙方应在收到货物后支付价款'", _B, "'万元，逾期付款的违约金为百分之'", _CN_SHARE, "'。'")
_CLAUSE_3 = _cat("'第三条 借款利率为每日千分之'", _cases("o_orderkey % 4", ["'五'", "'一'", "'半'", "'三'"]),
                 "'，本金'", _B, "'万元，逾期'", _A, "'天。'")
_CLAUSE_4 = "'第四条：争议由甲方所在地人民法院管辖。'"
_CLAUSE_5 = "'第五条、本合同自双方签字盖章之日起生效。'"

CONTRACTS = Derived(
    "orders",
    {
        "contract_id": "o_orderkey",
        "user_id": "o_custkey",
        "label": _cat("'doc'", _s("o_orderkey")),
        "text": _cases(
            "o_orderkey % 10",
            [
                _cat("'合同编号'", _s("o_orderkey"), "'，甲乙双方协商一致如下。'", "CHR(10)", _CLAUSE_1, "CHR(10)",
                     _CLAUSE_2, "CHR(10)", _CLAUSE_3, _CLAUSE_4, _CLAUSE_5),
                _cat(_CLAUSE_1, _CLAUSE_2),
                "'双方达成如下协议，共同遵守。'",
                _cat("'前言 '", "'第1条 '", "REPEAT('甲方应当配合乙方检查工程质量；', 80)", "'第2条 总则'", "'（一）'",
                     "REPEAT('乙方应及时付款。', 60)", "'（二）'", "REPEAT('甲方按期验收。', 70)", "'（三） 其他'", "'第3条 结束。'"),
                "'前言。第一条 甲。第二条 乙。第九条 丙。第三条 丁。第七条 戊'",
                _cat("'第一百二十条 买卖标的为货物'", _A, "'件。第一百二十一条 违约的应赔偿。第 一百二十二 条 依照第三条款办理'"),
                "'嗯'",
                _cat("'第1条 '", "REPEAT('甲', 1700)"),
                "'  '",
                _cat(_CLAUSE_3, "'第十二条 本合同自双方签字盖章之日起生效。'", _CLAUSE_5),
            ],
        ),
    },
)

STATUTES = Derived(
    "embeddings",
    {
        "chunk_id": _cat("'民法典-第'", _s("CAST(FLOOR(vec_id / 2) AS BIGINT)"), "'条#'", _s("vec_id % 2 + 1")),
        "kb_id": "'1'",
        "canonical_id": "CASE WHEN vec_id % 7 = 6 THEN NULL ELSE "
        + _cat("'民法典-第'", _s("CAST(FLOOR(vec_id / 2) AS BIGINT)"), "'条'") + " END",
        "content": _cases(
            "label % 5",
            [
                _cat("'当事人一方逾期付款的，应当支付违约金，约定的违约金过分高于造成的损失的，可以请求减少。第'", _s("vec_id"), "'款'"),
                _cat("'借款的利率不得违反国家有关规定，禁止高利放贷。第'", _s("vec_id"), "'款'"),
                _cat("'出卖人应当按照约定的期限交付标的物。第'", _s("vec_id"), "'款'"),
                _cat("'合同自双方签字或者盖章时成立并生效。第'", _s("vec_id"), "'款'"),
                _cat("'因合同纠纷提起的诉讼，由被告住所地人民法院管辖。第'", _s("vec_id"), "'款'"),
            ],
        ),
        "vector": "embedding",
    },
)

VECTORS = Derived("embeddings", {"vec_id": "vec_id", "label": "label", "vector": "embedding"})

DOC_CHUNKS = Derived(
    "documents",
    {
        "doc_id": "doc_id",
        "chunk_id": _cat("'doc'", _s("doc_id")),
        "kb_id": "'1'",
        "canonical_id": "CASE WHEN doc_id % 2 = 0 THEN " + _cat("'doc'", _s("doc_id")) + " ELSE NULL END",
        "content": "text",
    },
)

BENCH_QUERIES = Derived(
    "benchmark", {"item_id": "item_id", "query_id": _cat("'q'", _s("item_id")), "kb_id": "'1'", "text": "text"}
)

_TURN_SECONDS = "1704067200 + turn * 3600 + CAST(FLOOR(turn / 4) AS BIGINT) * 691200 + conv_id"

TURNS = Derived(
    "conversations",
    {
        "session_id": _cat("'s'", _s("conv_id")),
        "user_id": "conv_id % 40",
        "turn": "turn",
        "ts_sec": _TURN_SECONDS,
        "role": "role",
        "content": "CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN " + _cat("'（审查结论摘要）【已审查条款】'", "text")
        + " ELSE text END",
    },
)

ASKED = Derived(
    "conversations",
    {
        "question_id": "conv_id * 1000 + turn",
        "conv_id": "conv_id",
        "session_id": _cat("'s'", _s("conv_id")),
        "user_id": "conv_id % 40",
        "turn": "turn",
        "ts_sec": _TURN_SECONDS,
        "kb_id": "'1'",
        "text": _cases("(conv_id + turn) % 16", _question_options("(conv_id * 1000 + 5000)", "(conv_id % 60 + 1)")),
    },
    where="role = 'user'",
)

INTERACTIONS = Derived(
    "events",
    {
        "event_id": "event_id",
        "ts": "ts",
        "user_id": "user_id",
        "post_id": "CAST(FLOOR(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / 20) AS BIGINT)",
        "action": "CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'favorite' "
        "WHEN 'error' THEN 'unlike' ELSE 'unfavorite' END",
    },
)

POSTS = Derived(
    "part",
    {
        "id": "p_partkey + 1",
        "title": "p_name",
        "excerpt": "p_type",
        "cover_image": "p_brand",
        "content": _cat("p_name", "' / '", "p_type"),
        "category_id": "100 + p_partkey % 30",
    },
)

CATEGORY_PARTS = [
    Derived("region", {"id": "CAST(r_regionkey + 1 AS BIGINT)", "name": "r_name", "parent_id": "CAST(0 AS BIGINT)",
                       "level": "1", "icon": _cat("'i'", _s("r_regionkey")), "sort_order": "10 - r_regionkey"}),
    Derived("nation", {"id": "CAST(100 + n_nationkey AS BIGINT)", "name": "n_name",
                       "parent_id": "CAST(n_regionkey + 1 AS BIGINT)", "level": "2",
                       "icon": _cat("'i'", _s("n_nationkey")), "sort_order": "100 - n_nationkey"}),
    Derived("supplier", {"id": "1000 + s_suppkey", "name": "s_name", "parent_id": "CAST(100 + s_nationkey AS BIGINT)",
                         "level": "3", "icon": _cat("'i'", _s("s_suppkey")),
                         "sort_order": "CAST(s_suppkey % 1000 AS INT)"}),
]


def categories(spark: SparkSession, folder: str) -> DataFrame:
    first, *rest = [p.frame(spark, folder) for p in CATEGORY_PARTS]
    for other in rest:
        first = first.unionByName(other)
    return first


CATEGORIES_SQL = " UNION ALL ".join(p.sql() for p in CATEGORY_PARTS)


def statutes(spark: SparkSession, folder: str) -> DataFrame:
    return STATUTES.frame(spark, folder)


def doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks; a chunk has a vector when an embedding shares its id."""
    vectors = VECTORS.frame(spark, folder).select("vec_id", "vector")
    chunks = DOC_CHUNKS.frame(spark, folder)
    return chunks.join(vectors, chunks["doc_id"] == vectors["vec_id"], "left").drop("doc_id", "vec_id")


DOC_CHUNKS_SQL = (
    f"SELECT c.chunk_id, c.kb_id, c.canonical_id, c.content, v.vector FROM ({DOC_CHUNKS.sql()}) c "
    f"LEFT JOIN ({VECTORS.sql()}) v ON c.doc_id = v.vec_id"
)


def bench_queries(spark: SparkSession, folder: str) -> DataFrame:
    vectors = VECTORS.frame(spark, folder).select("vec_id", "vector")
    queries = BENCH_QUERIES.frame(spark, folder)
    return queries.join(vectors, queries["item_id"] == vectors["vec_id"], "left").drop("item_id", "vec_id")


BENCH_QUERIES_SQL = (
    f"SELECT q.query_id, q.kb_id, q.text, v.vector FROM ({BENCH_QUERIES.sql()}) q "
    f"LEFT JOIN ({VECTORS.sql()}) v ON q.item_id = v.vec_id"
)


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """User questions with a vector when an embedding shares the conversation's id."""
    vectors = VECTORS.frame(spark, folder).select("vec_id", "vector")
    questions = ASKED.frame(spark, folder)
    return questions.join(vectors, questions["conv_id"] == vectors["vec_id"], "left").drop("vec_id")


ASKED_SQL = (
    f"SELECT q.*, v.vector FROM ({ASKED.sql()}) q LEFT JOIN ({VECTORS.sql()}) v ON q.conv_id = v.vec_id"
)
