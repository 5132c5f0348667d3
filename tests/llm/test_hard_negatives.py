"""Hard negatives against scoring every pair, and the share of pairs that the walk scores."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import verify
from clauselake.llm import hard_negatives, queries


def plain(rows, every=100):
    """rows: (vec_id, vector, label). A multiset of the result's rows."""
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = collections.Counter()
    for at, (anchor, label, vector) in enumerate(kept):
        if anchor % every:
            continue
        scored = [(-sum(a * b for a, b in zip(vector, v, strict=True)), i, row, own) for row, (i, own, v) in enumerate(kept) if row != at and len(v) == len(vector)]
        scored.sort(key=lambda s: s[:2])
        for minus, positive, _, _ in [s for s in scored if s[3] == label][:5]:
            p = -minus
            negatives = [(-m, i) for m, i, _, own in scored if own != label and 80 * p <= -100 * m <= 100 * p][:5]
            for rank, (score, i) in enumerate(negatives, 1):
                out[anchor, positive, rank, i, p, score] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, score string, uid int")


def mined(spark, rows, every=100):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(table(spark, rows).repartition(5), F.col("vec_id") % every == 0, moved)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return collections.Counter(tuple(r) for r in found.collect())


def clustered(rng, n, dim, centres=12, spread=0.25):
    heart = rng.normal(size=(centres, dim))
    rows = heart[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))
    return np.float32(rows / np.linalg.norm(rows, axis=1, keepdims=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_vectors(spark, seed, monkeypatch):
    """Clustered vectors of several lengths, with ties, copies of one vector in a third of the rows, and small groups."""
    monkeypatch.setattr(hard_negatives, "GROUP", 3)
    monkeypatch.setattr(hard_negatives, "STEP", 16)
    rng = np.random.default_rng(seed)
    vectors = clustered(rng, 600, 6) * rng.choice([1, 1, 3, 0.1], size=(600, 1))
    vectors[::3] = vectors[0]
    rows = [(i, [float(x) for x in v], int(rng.integers(3))) for i, v in enumerate(vectors)]
    if seed == 2:
        monkeypatch.setattr(hard_negatives, "LEAST_SLABS", 40)
        rows += [(1000 + i, [0.5, float(i)], i % 2) for i in range(30)]
    assert mined(spark, rows, 20) == plain(rows, 20)


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [0.1 * (i % 5), 1.0, -0.2], i % 3) for i in range(0, 60, 2)]
    rows += [(100, None, 1), (200, [1.0, None, 1.0], 1), (300, [1.0, nan, 1.0], 1), (400, [inf, 0.0, 1.0], 2), (500, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(600, [0.0, 0.0, 0.0], 1), (700, [-1.0, -1.0, 0.5], 2), (800, [0.2, 0.9, 0.0], 1), (800, [0.2, 0.9, 0.0], 1), (900, [0.3, 0.9, 0.1], 0), (901, [0.3, 0.9, 0.1], 0)]
    rows += [(1000, [], 1), (1001, [], 1), (1002, [], 2), (1100, [5000.0, -3000.0], 1), (1101, [60000.0, 12.0], 1), (1103, [60000.0, 11.0], 2), (-100, [0.3, 0.8, 0.1], 1)]
    assert mined(spark, rows) == plain(rows)


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=3) * 200000)], int(rng.integers(2))) for i in range(0, 400, 2)]
    assert mined(spark, rows) == plain(rows)


def test_empty_tables(spark):
    assert mined(spark, []) == collections.Counter()
    assert mined(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)]) == collections.Counter()


def test_the_walk_ends_early():
    """Members stop before most of the list, and find what scoring all candidates finds."""
    rng = np.random.default_rng(7)
    vectors = np.floor(256 * clustered(rng, 20_000, 16, 40, 0.1).astype(np.float64))
    label = rng.integers(5, size=len(vectors))
    slab = hard_negatives.Slab(np.arange(len(vectors)), np.arange(len(vectors)), label, vectors)
    centres = hard_negatives.fit_centres(vectors[:2000], 40)
    own = np.argmax(hard_negatives.unit(vectors[:400])[0] @ centres.T, axis=1)
    for c in range(40):
        who = np.flatnonzero(own == c)
        if not len(who):
            continue
        low = np.int64(-(1 << 62))
        windows = np.tile(np.array([low, -low, low]), (len(who), 1, 1))
        anchors = {"cluster": c, "uid": who, "label": label[who], "vector": vectors[who], "windows": windows}
        row, _, score, found = hard_negatives.walk(slab, anchors, centres[c], True)
        for k, a in enumerate(who.tolist()):
            every = sorted(((-float(vectors[a] @ vectors[j]), j) for j in np.flatnonzero(label == label[a]) if j != a))[:5]
            assert [(-s, j) for s, j in every] == list(zip(score[row == k], found[row == k], strict=True))
    assert slab.scored < 0.3 * 400 * len(vectors)


def test_query_matches_its_oracle(spark):
    status, note = verify.compare(spark, verify.connect("/root/testdata/sf0.1"), "/root/testdata/sf0.1", "op13_hard_negatives", queries.ORACLES)
    assert status == "ok", note
