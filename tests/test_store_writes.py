"""What a write of the chunk store sends and how it sizes its buckets."""

import pytest
from pyspark.sql import functions as F

from clauselake.functions import text as tx
from clauselake.operators import postings
from clauselake.sources import chunk_store
from clauselake.sources.chunk_store import ChunkStore

SCHEMA = "chunk_id string, kb_id string, canonical_id string, content string, written_at long"


def made(spark, n=60):
    return spark.createDataFrame([(f"c{i}", f"k{i % 2}", None, f"违约金 alpha w{i % 7}", 1) for i in range(n)], SCHEMA)


def test_joined_tokens_are_the_tokens(spark):
    texts = [None, "", " .,", "Ab  c,d", "第1条 违约金ab 利率", "é²x_y\n\tZ", " 甲 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(tx.joined_tokens(F.col("t")).alias("j"), tx.word_tokens(F.col("t")).alias("w")).collect()
    assert all((r.j is None) == (r.w is None) and (r.j is None or [x for x in r.j.split(" ") if x] == r.w) for r in rows)
    assert all(r.j is None or r.j == " ".join(r.w) for r in rows)


def test_tokens_travel_as_one_text(spark):
    rows = postings.block_postings(made(spark).withColumn("bucket", F.lit(0)), 4)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.count("IsHan") == 1
    assert "filter(split(" not in plan


def test_the_first_write_sizes_the_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunk_store, "BUCKET_BYTES", 64)
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=2)
    store.upsert(made(spark))
    buckets = len(store.state()[1])
    assert buckets > 10 and {v for v in store.state()[1].values()} == {1}
    store.upsert(made(spark, 70).withColumns({"content": F.lit("beta"), "written_at": F.lit(2)}))
    assert len(store.state()[1]) == buckets
    assert {(r.chunk_id, r.content) for r in store.chunks().collect()} == {(f"c{i}", "beta") for i in range(70)}
    assert store.chunks().count() == 70 and store.index().chunks == 70


@pytest.mark.parametrize("writes", [1, 2])
def test_a_few_chunks_leave_buckets_empty(spark, tmp_path, writes):
    store = ChunkStore(spark, str(tmp_path / "store"))
    for n in range(writes):
        store.upsert(made(spark, 2 + n))
    assert len(store.state()[1]) == 16 and store.chunks().count() == 1 + writes
    store.remove(spark.createDataFrame([("c0",)], "chunk_id string"))
    assert store.chunks().count() == writes and store.index().chunks == writes
