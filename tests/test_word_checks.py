"""The words of a checklist are searched in one pass of a batch of texts, with the answers of the word tests."""

import random

from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.functions import text as tx
from clauselake.operators import clauses

GROUPS = [(name, words.split("|")) for name, words in lx.COMPLETENESS_ITEMS]


def test_names_lacking_agree_with_the_word_tests(spark):
    rng = random.Random(5)
    letters = [*"甲方之日起违约金台 \n.|(a", *(w for _, words in GROUPS for w in words)]
    texts = [None, "", " ", "之日", "之\n日", "违约", *("".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(400))]
    groups = [*GROUPS, ("odd", ["a.", "(a", "|", "台 "])]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.array_compact(F.array(*[F.when(~tx.contains_any(F.col("t"), words), F.lit(name)) for name, words in groups]))
    rows = df.select(plain.alias("want"), tx.names_lacking(F.col("t"), groups).alias("got")).collect()
    assert len(rows) == len(texts) and all(r.got == r.want for r in rows)
    assert len({tuple(r.got) for r in rows}) > 20


def test_a_contract_is_not_searched_word_by_word(spark):
    docs = spark.createDataFrame([(1, "第1条 甲方付款。第2条 乙方交货。"), (2, None), (3, "双方达成协议，共同遵守")], "id long, text string")
    found = clauses.missing_elements(docs.withColumn("n", F.expr("CASE id WHEN 1 THEN 2 ELSE 0 END")), "text", "n")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "仲裁委员会" not in plan and plan.count("ArrowEvalPython") == 1
    got = {r.id: r.missing for r in found.collect()}
    assert got == {1: ["合同标的", "数量", "交付时间", "违约责任", "争议解决", "生效条件"], 2: [], 3: [n for n, _ in GROUPS if n != "合同主体"]}
