"""Streams: runs that follow one another, restarts, and several small batches against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from clauselake.operators import engage, session
from clauselake.runtime import scratch_path
from clauselake.sources.tables import read_table, stream_table
from clauselake.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def test_rounds_are_appended_once(spark):
    path = scratch_path(spark, "test-rounds")
    jobs.append_rounds(stream_table(spark, FOLDER, "conversations").select("conv_id", "turn", "text"), path)
    stored = spark.read.schema("conv_id long, turn long, text string, batch long").parquet(path)
    assert stored.count() == stored.select("conv_id", "turn").distinct().count()
    assert stored.count() == read_table(spark, FOLDER, "conversations").count()


def test_later_runs_keep_earlier_rounds(spark):
    arriving, path = scratch_path(spark, "test-arriving"), scratch_path(spark, "test-later")
    schema = "id long, text string"
    for load in ([(1, "a"), (2, "b")], [(3, "c")], []):
        spark.createDataFrame(load, schema).coalesce(1).write.mode("append").parquet(arriving)
        jobs.append_rounds(spark.readStream.schema(schema).parquet(arriving), path)
        jobs.append_rounds(spark.readStream.schema(schema).parquet(arriving), path)  # a restart finds nothing new
    stored = spark.read.schema(schema).parquet(path).select("id", "text")
    assert sorted(map(tuple, stored.collect())) == [(1, "a"), (2, "b"), (3, "c")]


@pytest.fixture
def in_files(spark):
    """Writes rows in several files of consecutive rows and reads them one file a batch."""

    def stream(df, order, files=4):
        path = scratch_path(spark, "test-files")
        rows = [tuple(r) for r in df.orderBy(*order).collect()]
        size = -(-len(rows) // files)
        for i in range(0, len(rows), size):
            spark.createDataFrame(rows[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return stream


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_marks_in_many_batches(spark, in_files):
    rng, rows, at = random.Random(5), [], 0
    hour = 3_600_000_000
    for i in range(300):
        at += rng.choice([1, hour, 9 * hour])
        rows.append((i, rng.choice([1, 1, 1, 2]), 1, rng.choice(["like", "like", "unlike"]), at))
    df = spark.createDataFrame(rows, "event_id long, user_id long, post_id long, action string, at long")
    got = jobs.drain(jobs.guarded_marks(in_files(df, ["at", "event_id"]), "like", "unlike"), "test-marks")
    want = engage.guarded_marks(df, "like", "unlike").select("event_id", "user_id", "post_id", "action", "accepted")
    assert _rows(got) == _rows(want)


def test_sightings_after_their_lifetime(spark, in_files):
    day = 86_400_000_000
    df = spark.createDataFrame([("a", d * day) for d in (0, 1, 6, 7, 8, 13, 15)] + [("b", 3 * day)], "text_hash string, ts_us long")
    got = jobs.drain(jobs.first_sightings(in_files(df, ["ts_us"])), "test-sightings")
    assert _rows(got) == sorted([("a", 0), ("a", 7 * day), ("a", 15 * day), ("b", 3 * day)], key=str)


def test_every_third_round_in_many_batches(spark, in_files):
    rows = [(s * 100 + t, f"s{s}", t, t * 60) for s in range(3) for t in range(11)]
    df = spark.createDataFrame(rows, "question_id long, session_id string, turn long, ts_sec long")
    got = jobs.drain(jobs.every_nth_round(in_files(df, ["turn"])), "test-third")
    assert _rows(got) == _rows(session.every_nth_round(df).select("question_id", "session_id", "round_no"))


def test_metrics_start_anew_after_a_reset(spark, in_files):
    kinds = ["hit", "miss", "hit", "reset", "miss", "hit", "hit", "reset", "miss"]
    rows = [("f", i, k) for i, k in enumerate(kinds)] + [("g", i, "hit") for i in range(9)] + [("h", 3, "reset")]
    df = spark.createDataFrame(rows, "facet string, seq long, kind string")
    for block in (2, 3, 100):
        path = scratch_path(spark, "test-metrics")
        got = jobs.memory_metrics(in_files(df, ["seq"]), path, block=block)
        assert _rows(got) == [("f", 2, 0, 1), ("g", 0, 9, 0), ("h", 1, 0, 0)]
        blocks = spark.read.parquet(path)
        assert blocks.count() <= 4 * 3 * (9 // block + 1)  # one row a facet, block and batch


def test_history_of_the_newest_lifetime(spark):
    day = 86400
    rows = [("s", t, "user", f"m{t}", t * 60) for t in range(5)] + [("s", t, "user", f"m{t}", 30 * day + t) for t in range(5, 8)]
    rows += [("l", t, "user", f"m{t}", t) for t in range(40)]
    turns = spark.createDataFrame(rows, "session_id string, turn long, role string, content string, ts_sec long")
    kept = session.history_window(turns).groupBy("session_id").agg(F.min("turn"), F.count("*"), F.max("messages"))
    assert _rows(kept) == [("l", 32, 8, 40), ("s", 5, 3, 3)]
    failed = session.history_window(turns, compacted=False).groupBy("session_id").agg(F.min("turn"), F.count("*"))
    assert _rows(failed) == [("l", 20, 20), ("s", 5, 3)]


def _run_live(stream, name):
    """Runs a live stream to its end and returns the written rows and the state rows after each batch."""
    path = scratch_path(stream.sparkSession, name)
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return stream.sparkSession.read.schema(stream.schema).parquet(path), held


def test_memories_end_by_timers(spark, in_files):
    """State is freed when event time passes its lifetime, though no further row of its session comes."""
    day = 86400
    rows = [(s * 100 + t, f"s{s}", t, day * (1 + s * 3) + t * 60) for s in range(6) for t in range(4)] + [(900, "s0", 9, 40 * day), (901, "s9", 1, 60 * day)]
    none = "CAST(NULL AS DOUBLE) AS model_principal, CAST(NULL AS DOUBLE) AS model_rate, CAST(NULL AS INT) AS model_days"
    turns = spark.createDataFrame(rows, "question_id long, session_id string, turn long, ts_sec long").selectExpr(
        "question_id", "session_id", "turn", "ts_sec", "CONCAT('本金', CAST(question_id AS STRING), '元') AS text", *none.split(", "), "array(CONCAT('c', CAST(turn AS STRING))) AS clause_ids"
    )
    got, held = _run_live(jobs.session_memory(in_files(turns, ["ts_sec"], 8), live=True, delay="0 seconds"), "test-live")
    ended = {(r.session_id, r.epoch, r.previous_ids) for r in got.filter("question_id IS NULL").collect()}
    # s0 was freed before its later turn, so that turn starts a memory of its own
    assert ended == {(f"s{s}", 0, "c3") for s in range(6)} | {("s0", 0, "c9")}
    assert max(held) < 3 * 7 and held[-1] < max(held)
    plain = jobs.drain(jobs.session_memory(in_files(turns, ["ts_sec"], 8)), "test-plain")
    same = ["session_id", "question_id", "principal", "rate", "days", "calc_type", "previous_ids"]
    assert _rows(got.filter("question_id IS NOT NULL").select(*same)) == _rows(plain.select(*same))


def test_live_marks_and_sightings_equal_the_batch(spark, in_files):
    hour = 3_600_000_000
    rng, rows, at = random.Random(6), [], hour
    for i in range(200):
        at += rng.choice([1, hour, 30 * hour])
        rows.append((i, rng.randrange(4), 1, rng.choice(["like", "like", "unlike"]), at))
    df = spark.createDataFrame(rows, "event_id long, user_id long, post_id long, action string, at long")
    got, held = _run_live(jobs.guarded_marks(in_files(df, ["at", "event_id"], 8), "like", "unlike", live=True, delay="0 seconds"), "test-live-marks")
    want = engage.guarded_marks(df, "like", "unlike").select("event_id", "user_id", "post_id", "action", "accepted")
    assert _rows(got) == _rows(want)
    texts = df.selectExpr("CONCAT('t', CAST(user_id AS STRING)) AS text_hash", "at AS ts_us")
    got, _ = _run_live(jobs.first_sightings(in_files(texts, ["ts_us"], 8), 2, live=True, delay="0 seconds"), "test-live-texts")
    assert _rows(got) == _rows(jobs.drain(jobs.first_sightings(in_files(texts, ["ts_us"], 8), 2), "test-texts"))


def test_windows_count_late_rows_apart(spark):
    """Four files of one batch each; a row comes after its window has closed, another before."""
    path = scratch_path(spark, "test-windows")
    hour = 3600
    for load in ([(1, 10), (1, 20)], [(1, 5 * hour), (2, 5 * hour)], [(1, 9 * hour)], [(1, 30), (1, 8 * hour), (3, 40)]):
        df = spark.createDataFrame(load, "post_id long, sec long").selectExpr("post_id", "timestamp_seconds(sec) AS at")
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("post_id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.windowed_views(stream, hour, 2 * hour).selectExpr("post_id", "unix_seconds(window_start) AS start", "views", "late", "closed")
    assert _rows(got) == _rows(spark.createDataFrame(
        [(1, 0, 2, 1, True), (3, 0, 0, 1, True), (1, 5 * hour, 1, 0, True), (2, 5 * hour, 1, 0, True), (1, 8 * hour, 1, 0, False), (1, 9 * hour, 1, 0, False)],
        "post_id long, start long, views long, late long, closed boolean"))


def _chat(spark, loads):
    path = scratch_path(spark, "test-chat")
    for load in loads:
        spark.createDataFrame([(line,) for line in load], "value string").coalesce(1).write.mode("append").text(path)
    return jobs.read_chat_log(spark, path)


def _said(message, seq, sec, text, kind="answer"):
    return f'{message}\t{seq}\t{sec}\tdata: {{"type":"{kind}","role":"assistant","content":"{text}"}}'


CHAT = [
    [_said(1, 1, 1, "a"), _said(2, 2, 1, "x"), "no log line", "1\t3\t2\tevent: ping"],
    [_said(1, 4, 3, "b"), _said(1, 5, 4, "more?", "follow_up"), "1\t6\t4\tdata: {broken", _said(3, 7, 5, "lost")],
    ["1\t8\t6\tdata: [DONE]", _said(1, 9, 7, "second part"), "4\t10\t8\tdata:[DONE]", "\t\t", "9999999999999999999999\t1\t1\tx"],
    [_said(1, 11, 9, " ends"), "1\t12\t9\tdata: [DONE]", _said(2, 13, 5000, "y"), _said(2, 14, 5001, "z"), "2\t15\t5002\tdata: [DONE]"],
    [_said(5, 16, 99_999, "open")],
]


def test_chat_messages_over_files(spark):
    whole = [(1, 0, 2, 1, "ab", True), (1, 1, 2, 0, "second part ends", True), (4, 0, 0, 0, "", True), (2, 0, 1, 0, "x", False), (2, 1, 2, 0, "yz", True)]
    got = jobs.drain(jobs.chat_messages(_chat(spark, CHAT), 1000), "test-messages")
    assert sorted(map(tuple, got.collect())) == sorted(whole)
    live, held = _run_live(jobs.chat_messages(_chat(spark, CHAT), 1000, live=True, delay="0 seconds"), "test-live-messages")
    # by its timer, message 3 ends incomplete; message 2 does so while others go on, and then starts anew
    ended = [m if m[:2] != (2, 1) else (2, m[1], *m[2:]) for m in whole] + [(3, 0, 1, 0, "lost", False)]
    assert sorted(map(tuple, live.collect())) == sorted(ended)
    bad = jobs.drain(jobs.malformed_lines(_chat(spark, CHAT)), "test-malformed")
    assert sorted(map(tuple, bad.collect())) == sorted([("no log line", "form"), ("1\t6\t4\tdata: {broken", "json"), ("\t\t", "form"), ("9999999999999999999999\t1\t1\tx", "form")])


def test_counters_of_rounds_have_a_lifetime(spark, in_files):
    day = 86400
    rows = [(t, "s", t, t * 60 + (40 * day if t > 3 else 0)) for t in range(10)]
    df = spark.createDataFrame(rows, "question_id long, session_id string, turn long, ts_sec long")
    want = [(2, "s", 3), (6, "s", 3), (9, "s", 6)]
    assert _rows(session.every_nth_round(df).select("question_id", "session_id", "round_no")) == want
    assert _rows(jobs.drain(jobs.every_nth_round(in_files(df, ["turn"])), "test-lifetime")) == want


def test_a_run_that_ends_has_no_call_for_each_key(spark, in_files, monkeypatch, tmp_path):
    """Spark's keyed state took a call of Python for each key; a pass over sorted rows goes on from the memories written before."""
    monkeypatch.setattr(jobs, "WHOLE_EVERY", 3)
    rows = [(f"h{i % 300}", i * 1000) for i in range(4000)] + [("once", 5), (None, 7), (None, 8)]
    texts = spark.createDataFrame(rows, "text_hash string, ts_us long")
    job = jobs.first_sightings(in_files(texts, ["ts_us"], 8), 1 / 86400)
    assert isinstance(job, jobs.Steps)
    path = str(tmp_path / "sightings")
    want, seen = [], {}
    for key, at in sorted(rows, key=lambda r: r[1]):
        if key not in seen or at - seen[key] >= 1_000_000:
            seen[key] = at
            want.append((key, at))
    for _ in range(2):  # the second run goes on after the first and finds nothing new
        assert sorted(map(tuple, jobs.drain(job, "unused", path).collect()), key=str) == sorted(want, key=str)
    kept = spark.read.parquet(path).filter("kept = 'true'").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in kept}[6] == 302


def test_marks_without_a_user_have_no_memory(spark, in_files):
    rows = [(1, None, 1, "like", 10), (2, None, 1, "like", 20), (3, None, 1, "unlike", 30), (4, 7, 1, "like", 40), (5, 7, 1, "like", 50), (6, 7, 1, "unlike", 60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, post_id long, action string, at long")
    got = jobs.drain(jobs.guarded_marks(in_files(df, ["event_id"], 2), "like", "unlike"), "test-no-user")
    assert [r["accepted"] for r in got.orderBy("event_id").collect()] == [True, True, False, True, False, True]
