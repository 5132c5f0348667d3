"""The paths for hot keys and large sides give what the plain computation gives."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clauselake.operators import clauses, engage, postings, search, session, vectors
from clauselake.operators.ordered import Scan, running
from clauselake.operators.skew import lookup_join
from clauselake.sources import records


def test_running_equals_plain_window(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rng.choice([None, i, -i])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    scans = [Scan(n, n, F.col("v")) for n in ("sum", "last", "first", "prev")]
    got = running(df, ["k"], ["t"], F.floor(F.col("t") / 17), scans)
    w = Window.partitionBy("k").orderBy("t")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("sum"), F.last("v", True).over(upto).alias("last"),
        F.first("v", True).over(upto).alias("first"), F.last("v", True).over(before).alias("prev"),
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_clamped_counter_and_guarded_marks_brute_force(spark):
    rng = random.Random(11)
    hour = 3_600_000_000
    rows, at = [], 0
    for i in range(1500):
        at += rng.choice([0, 1, hour // 3, hour, 5 * hour, 30 * hour])
        hot = rng.random() < 0.6
        rows.append((i, 1 if hot else rng.randrange(4), 1 if hot else rng.randrange(3), rng.choice(["like"] * 6 + ["unlike"]), at))
    df = spark.createDataFrame(rows, "event_id long, user_id long, post_id long, action string, at long")
    got = {r.event_id: r.accepted for r in engage.guarded_marks(df, "like", "unlike").collect()}
    live, counters, want = {}, {}, {}
    for eid, user, post, action, t in rows:
        mark = live.get((user, post))
        alive = mark is not None and t - mark < engage.MARK_MICROS
        want[eid] = alive if action == "unlike" else not alive
        if action == "unlike":
            live.pop((user, post), None)
        elif not alive:
            live[(user, post)] = t
        counters[post] = max(0, counters.get(post, 0) + (1 if action == "like" else -1))
    assert got == want
    deltas = df.withColumn("delta", F.expr("CASE WHEN action = 'like' THEN 1 ELSE -1 END"))
    counted = engage.clamped_counter(deltas, ["post_id"], ["at", "event_id"], engage.hour_block())
    assert {r.post_id: r.counter for r in counted.collect()} == counters


def test_a_busy_hour_is_cut_into_slices(spark):
    rng = random.Random(12)
    rows = sorted((1 if rng.random() < 0.8 else 2, rng.randrange(2 * engage.HOUR_MICROS), i, rng.choice([1, 1, -1])) for i in range(600))
    rows += [(1, 5_000_000, 1000 + i, 1) for i in range(40)]  # one moment cannot be cut
    df = spark.createDataFrame(rows, "post_id long, at long, event_id long, delta int")
    blocked = engage.busy_blocks(df, ["post_id"], limit=20)
    sizes = blocked.groupBy("post_id", "block").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 90 and sizes[1] > 20
    counters = {}
    for post, _, _, delta in sorted(rows, key=lambda r: (r[1], r[2])):
        counters[post] = max(0, counters.get(post, 0) + delta)
    got = engage.clamped_counter(blocked, ["post_id"], ["at", "event_id"], F.col("block"))
    assert {r.post_id: r.counter for r in got.collect()} == counters


def test_decrements_stop_at_zero(spark):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate([-1, -1, 1, -1, -1, 1, 1])], "p int, at long, delta int")
    assert engage.clamped_counter(df, ["p"], ["at"], F.floor(F.col("at") / 2)).head().counter == 2


def _corpus(spark):
    rng = np.random.default_rng(3)
    words = ["违约金", "交付", "标的", "利率", "合同", "alpha", "beta"]

    def text():
        return " ".join(rng.choice(words, size=int(rng.integers(1, 9))))

    chunks = [(f"c{i}", f"k{i % 2}", None if i % 5 == 0 else f"a{i // 2}", text(), [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    queries = [(f"q{i}", f"k{i % 2}", text(), [float(x) for x in rng.normal(size=8)]) for i in range(25)]
    return (
        spark.createDataFrame(queries, "query_id string, kb_id string, text string, vector array<float>"),
        spark.createDataFrame(chunks, "chunk_id string, kb_id string, canonical_id string, content string, vector array<float>"),
        queries, chunks,
    )


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _plain_bm25(raw_q, raw_c, k):
    words = lambda t: re.sub(r"([\u4e00-\u9fff])", r" \1 ", t.lower()).split()
    tokens = {c[0]: words(c[3]) for c in raw_c}
    df = collections.Counter(t for ts in tokens.values() for t in set(ts))
    n, average = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    out = []
    for qid, kb, text, _ in raw_q:
        asked, scored = collections.Counter(words(text)), []
        for cid, ckb, _, _, _ in raw_c:
            tf = collections.Counter(tokens[cid])
            if ckb == kb:
                score = sum(w * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] / (tf[t] + 1.2 * (0.25 + 0.75 * len(tokens[cid]) / average)) for t, w in asked.items() if tf[t])
                if round(score, 6) > 0:
                    scored.append((-round(score, 6), cid))
        out += [(qid, cid, -s, r) for r, (s, cid) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def _plain_knn(raw_q, raw_c, k):
    out = []
    unit = lambda v: v / max(1e-300, np.sqrt(v @ v))
    for qid, kb, _, v in raw_q:
        q = unit(np.asarray(v, dtype=np.float32).astype(float))
        scored = sorted((-round((1 + q @ unit(np.asarray(w, dtype=np.float32).astype(float))) / 2, 6), cid) for cid, ckb, _, _, w in raw_c if ckb == kb and w is not None)
        out += [(qid, cid, -s, r) for r, (s, cid) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.fixture(params=["one block", "many blocks"])
def small_blocks(request, monkeypatch):
    if request.param == "many blocks":
        for module, sizes in ((postings, {"BLOCK_CHUNKS": 7, "QUERY_GROUP": 4, "PRUNE_FROM": 0, "OUT_ROWS": 5}), (vectors, {"BLOCK_VECTORS": 6, "QUERY_GROUP": 4, "PRUNE_FROM": 0, "SAMPLE": 50})):
            for name, value in sizes.items():
                monkeypatch.setattr(module, name, value)
    return request.param


def test_search_paths_agree(spark, small_blocks):
    queries, chunks, raw_q, raw_c = _corpus(spark)
    assert _rows(search.bm25_topk(queries, chunks, 7)) == _plain_bm25(raw_q, raw_c, 7)
    assert _rows(search.knn_topk(queries, chunks, 7)) == _plain_knn(raw_q, raw_c, 7)
    index = search.search_index(chunks)
    assert (index.lexical.most_blocks > 5) == (small_blocks == "many blocks")
    first = _rows(search.hybrid_search(queries, index, 5))
    assert first == _rows(search.hybrid_search(queries, chunks, 5)) and len(first) == 25 * 5


def test_a_search_reads_the_partitions_of_its_terms(spark):
    _, chunks, _, _ = _corpus(spark)
    index = postings.postings_index(chunks)
    one = spark.createDataFrame([("q", "k0", "alpha")], "query_id string, kb_id string, text string")
    plan = postings.bm25_hits(one, index, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"part#\d+ (?:=|IN) ", plan)
    assert len(postings.bm25_hits(one, index, 3).collect()) == 3


def test_texts_without_terms_and_empty_tables(spark, small_blocks):
    queries, chunks, _, _ = _corpus(spark)
    odd = spark.createDataFrame([("x1", "k0", None, None, [0.0] * 8), ("x2", "k0", "a", "？！", None), ("x3", "k9", None, "alpha", [1.0] * 8)], chunks.schema)
    more = spark.createDataFrame([("n", "k0", None, None), ("z", "k0", "...", [0.0] * 8), ("o", "k9", "alpha", [1.0] * 8)], queries.schema)
    every = chunks.unionByName(odd)
    got = _rows(search.knn_topk(more, every, 200))
    assert {r[0] for r in got} == {"z", "o"} and {r[2] for r in got if r[0] == "z"} == {0.5} and ("o", "x3", 1.0, 1) in got
    assert [r[:2] for r in _rows(search.bm25_topk(more, every, 5))] == [("o", "x3")]
    assert search.hybrid_search(more.limit(0), every, 5).collect() == []
    assert search.hybrid_search(queries, chunks.limit(0), 5).collect() == []


def test_vector_search_compares_a_small_share(spark, monkeypatch):
    """Clustered vectors: under a fifth of them is compared, and the result is that of comparing all."""
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 64)
    rng = np.random.default_rng(5)
    heart = rng.normal(size=(30, 16))
    made = lambda n: [[float(x) for x in heart[rng.integers(30)] + 0.15 * rng.normal(size=16)] for _ in range(n)]
    raw_c = [(f"c{i:05d}", "k", None, "x", v) for i, v in enumerate(made(4000))]
    raw_q = [(f"q{i}", "k", "x", v) for i, v in enumerate(made(40))]
    chunks = spark.createDataFrame(raw_c, "chunk_id string, kb_id string, canonical_id string, content string, vector array<float>")
    queries = spark.createDataFrame(raw_q, "query_id string, kb_id string, text string, vector array<float>")
    index = vectors.vector_index(chunks)
    assert _rows(search.knn_topk(queries, index, 10)) == _plain_knn(raw_q, raw_c, 10)
    shares = vectors.compared_share(queries, index, 10).collect()
    assert len(shares) == 40 and sum(r.share for r in shares) / 40 < 0.2 and all(r.total == 4000 for r in shares)


def test_rrf_arithmetic(spark):
    schema = "query_id string, chunk_id string, clause_id string, rank int"
    knn = spark.createDataFrame([("q", "a#1", "a", 1), ("q", "a#2", "a", 2), ("q", "b", "b", 3)], schema)
    bm25 = spark.createDataFrame([("q", "b", "b", 1), ("q", "c", "c", 1)], schema)
    got = {r.clause_id: r.score for r in search.rrf_fuse(knn, bm25, 5).collect()}
    assert got == {"a": 0.174242, "b": 0.104196, "c": 0.027273}


def test_lookup_join_paths_agree(spark):
    rows = spark.range(400).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE CAST(id AS STRING) END AS k")
    lookup = spark.createDataFrame([("hot", 1)] + [(str(i), i) for i in range(0, 400, 2)], "k string, v int")
    plain = lookup_join(rows, lookup, ["k"]).select("id", "k", "v")
    want = sorted(map(tuple, plain.collect()), key=str)
    for frequent in (50, 1000):
        salted = lookup_join(rows, lookup, ["k"], salts=5, limit=0, frequent=frequent).select("id", "k", "v")
        assert sorted(map(tuple, salted.collect()), key=str) == want
    inner = lookup_join(rows, lookup, ["k"], "inner", salts=5, limit=0, frequent=50)
    assert inner.count() == sum(r[2] is not None for r in want)


def test_retained_history(spark):
    for n, keep in [(8, 8), (9, 9), (10, 8), (11, 9), (30, 8)]:
        turns = spark.range(n).selectExpr("'s' AS session_id", "id AS turn", "'user' AS role", "'x' AS content", "id * 60 AS ts_sec")
        assert session.history_window(turns).count() == keep


def test_pages_continue_in_parts(spark):
    pages = spark.range(5).selectExpr("1 AS record_id", "id + 1 AS page", "CONCAT('t', CAST(id AS STRING)) AS text")
    parts = records.assemble_pages(pages, 2).orderBy("part").collect()
    assert "".join(p.text for p in parts) == "".join(f"【第{i + 1}页】\nt{i}\n\n" for i in range(5))
    assert [p.pages for p in parts] == [2, 2, 1]
    assert [p.parts for p in parts] == [3, 3, 3]
    whole = records.assemble_pages(pages).collect()
    assert [(r.pages, r.text) for r in whole] == [(5, "".join(p.text for p in parts))]


def test_short_messages_stay_whole_wherever_their_numbers_lie(spark):
    rows = [(m, 4090 + 5 * m + i, "chunk", f"{m}-{i};") for m in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "message_id int, seq long, chunk_type string, text string")
    got = {r.message_id: r.text for r in records.full_answers(df).collect()}
    assert got == {m: "".join(f"{m}-{i};" for i in range(5)) for m in range(3)}


def test_truncation_keeps_every_contract(spark):
    df = spark.createDataFrame([(1, "短"), (2, None), (3, "甲" * 30), (4, "乙" * 12)], "id int, text string")
    got = {r.id: (r.too_short, r.dropped_chars, r.analysis_text) for r in clauses.truncate_contracts(df, "text", 20).collect()}
    assert got[1] == (True, 0, None) and got[2] == (True, 0, None) and got[4] == (False, 0, "乙" * 12)
    assert got[3][:2] == (False, 10) and got[3][2].startswith("甲" * 20) and not got[3][2].startswith("甲" * 21)


def test_wide_tables_are_not_broadcast(spark):
    from clauselake.runtime import small_enough

    df = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "i int, t string")
    assert small_enough(df, 50) and not small_enough(df, 49) and not small_enough(df, 50, 40_000)
