"""Profiles in any split of their signals, rounds that are saved once, hierarchies with loops, and intervals of rates."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from clauselake.operators import answer, engage, evaluate, profile
from clauselake.sources import records
from clauselake.sources.profile_store import ProfileStore, due_signals

SIGNAL = (
    "user_id long, seq long, ts_sec long, topics array<string>, contracts array<string>, preferences map<string,string>, "
    "freq_qa array<struct<q:string,clause:string>>, review_history array<struct<clause:string,risk:string>>, "
    "corrections array<struct<wrong:string,right:string>>"
)


def made_signals(n=120, seed=2):
    rng = random.Random(seed)
    some = lambda v: rng.choice([None, [], v])
    return [
        (rng.choice([1, 1, 1, 2, 3, None]), i, i, some([f"t{rng.randrange(6)}", " t1 ", ""]), some(["old"]), rng.choice([None, {"k": f"v{i}", f"k{i % 4}": "w"}]),
         some([(f"q{rng.randrange(5)}", f"c{i}")]), some([(f"r{rng.randrange(3)}", rng.choice(["", "risk"]))]), some([("wrong", f"right{i}")]))
        for i in range(n)
    ]


def rows(df):
    return sorted(map(tuple, df.select("user_id", "field", "seq", "pos", "key", "value").collect()), key=str)


def test_any_split_of_the_signals_gives_one_profile(spark, tmp_path):
    made = made_signals()
    signals = spark.createDataFrame(made, SIGNAL)
    resets = spark.createDataFrame([(1, 40), (1, 20), (2, 90)], "user_id long, reset_seq long")
    whole = rows(profile.merge_profiles(signals, resets))
    for name, cuts in (("one", [120]), ("three", [33, 70, 120]), ("again", [60, 30, 120])):
        store, start = ProfileStore(spark, str(tmp_path / name), 4), 0
        for cut in cuts:  # a cut before the one before it repeats signals that have come already
            part = signals.filter(F.col("seq").between(min(start, cut - 20), cut - 1))
            store.merge(part, resets.filter(F.col("reset_seq").between(min(start, cut - 20), cut - 1)))
            start = max(start, cut)
        assert rows(store.entries()) == whole, name
    assert ProfileStore(spark, str(tmp_path / "none")).entries().collect() == []


def test_profiles_touch_the_buckets_of_their_users(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "store"), 6)
    store.merge(spark.createDataFrame([(u, u, u, ["t"], None, None, None, None, None) for u in range(40)], SIGNAL))
    store.merge(spark.createDataFrame([(7, 100, 1, ["new"], None, None, None, None, None)], SIGNAL))
    commit, versions = store.state()
    assert commit == 2 and sorted(versions.values()) == [1] * 5 + [2]
    assert store.entries().count() == 41


def test_signals_of_every_third_round(spark):
    day = 86400
    rounds = spark.createDataFrame([(t, "s", t, t * 60 + (40 * day if t > 3 else 0)) for t in range(8)], "question_id long, session_id string, turn long, ts_sec long")
    signals = spark.createDataFrame([(t, t) for t in range(8)], "user_id long, seq long")
    assert sorted(r.seq for r in due_signals(rounds, signals).collect()) == [2, 6]


def test_answered_rounds_are_saved_once(spark, tmp_path):
    found = spark.createDataFrame([(1, "s", "q1", "c", 2, None), (2, "s", "q2", None, None, "refused"), (3, "t", "q3", "c", 1, None)], "question_id long, session_id string, text string, context string, passages int, refusal string")
    proses = spark.createDataFrame([(1, "a1"), (2, "a2"), (3, None)], "question_id long, prose string")
    path = str(tmp_path / "rounds")
    answered = answer.answered_rounds(found, proses)
    for _ in range(2):
        records.append_new_rounds(answered, path)
    records.append_new_rounds(answer.answered_rounds(found, spark.createDataFrame([(3, "a3")], "question_id long, prose string")), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("s", 1, "q1", "a1", 2), ("t", 3, "q3", "a3", 1)]


def test_loops_in_a_hierarchy_end(spark):
    made = [(1, "root", 0), (2, "a", 1), (3, "b", 2), (2, "a", 3), (4, "own", 4), (4, "own", 1), (5, "far", 6), (6, "far", 5)]
    table = spark.createDataFrame(made, "id long, name string, parent_id long")
    tree = sorted((r.id, r.path) for r in engage.category_tree(table).collect())
    assert tree == [(1, "1"), (2, "1/2"), (3, "1/2/3"), (4, "1/4")]
    assert sorted((r.id, r.path) for r in engage.category_cycles(table).collect()) == [(2, "1/2/3/2"), (4, "1/4/4")]


def test_intervals_repeat_their_weights(spark):
    rng = random.Random(1)
    cases = [(i, rng.choice([None, 1, 2, 4])) for i in range(300)]
    table = spark.createDataFrame(cases, "query_id long, best int")
    hits = table.filter("best IS NOT NULL").selectExpr("query_id", "'c' AS clause_id", "best AS rank")
    gold = table.selectExpr("query_id", "'c' AS clause_id")
    got = {r.metric: r for r in evaluate.retrieval_intervals(table, hits, gold, replicates=80).collect()}

    def weight(case, replicate):
        drawn = int(hashlib.md5(f"{case}#{replicate}".encode()).hexdigest()[:8], 16)
        return sum(drawn >= p for p in evaluate.POISSON)

    weights = np.array([[weight(i, r) for i, _ in cases] for r in range(1, 81)])
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05
    hit = np.array([b is not None and b <= 3 for _, b in cases], float)
    rates = weights @ hit / weights.sum(axis=1)
    r = got["hr_at_3"]
    assert (r.value, r.lower, r.upper) == tuple(round(float(v), 6) for v in (hit.mean(), np.quantile(rates, 0.025), np.quantile(rates, 0.975)))
    assert all(g.lower <= g.value <= g.upper for g in got.values())
    none = evaluate.refusal_intervals(spark.createDataFrame([(1, False, False)], "q long, should_refuse boolean, refused boolean"), "q")
    assert {(r.metric, r.value, r.lower, r.upper) for r in none.collect()} == {("precision", None, None, None), ("recall", None, None, None)}
