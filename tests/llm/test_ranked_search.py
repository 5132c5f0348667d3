"""Ranked search against scoring every document, the signature's bounds, and the share of documents scored exactly."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import verify
from clauselake.llm import queries, ranked_search
from fixtures import edge_docs, edge_texts, empty_docs, lower

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(lower(text)) if text is not None else []


def plain_search(docs, items, top=50):
    """docs and items: (id, text). A multiset of (item_id, rank, doc_id, score)."""
    counted = [(d, collections.Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, all_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = collections.Counter()
    for i, text in set(items):
        asked, found = set(terms_of(text)), []
        for d, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top], 1):
            out[i, rank, d, -score] += 1
    return out


def rows(df):
    return collections.Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def bench(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")


ITEMS = [
    (1, "the model of data"), (2, "IDIOT trash! trash"), (3, None), (4, ""), (5, "?? --"), (6, "nowhereseen"), (7, "漢字 É é"), (None, "copy"),
    (8, "the of and to"), (1, "the model of data"), (1, "other line"), (9, "it " * 500 + "s1ngle"),
]


@pytest.mark.parametrize("top", [3, 50])
def test_edge_texts(spark, top):
    texts = edge_texts(n=120)
    got = ranked_search.search(edge_docs(spark, texts).repartition(5), bench(spark, ITEMS), top)
    assert rows(got) == plain_search([(d, t) for d, t in texts], ITEMS, top)


def test_many_blocks_ties_and_sets(spark, monkeypatch):
    """Small blocks, several item sets, a first search that finds floors, equal texts in a third of the rows."""
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 8)
    monkeypatch.setattr(ranked_search, "SAMPLE", 2)
    monkeypatch.setattr(ranked_search, "BOUNDS_AT_ONCE", 500)
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    texts = [(i, "the same text of w1 w2 w2 w3" if i % 3 == 0 else " ".join(word() for _ in range(rng.choice([1, 5, 30, 400])))) for i in range(700)]
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 12)))) for k in range(40)]
    want = plain_search(texts, items, 7)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    assert rows(ranked_search.search(docs, bench(spark, items), 7)) == want
    monkeypatch.setattr(ranked_search, "SET_TERMS", 60)
    assert len(ranked_search.item_sets(bench(spark, items), 60)) > 2
    assert rows(ranked_search.search(docs, bench(spark, items), 7)) == want


def test_bounds_hold_and_exclude(spark):
    """No score is above its bound, and few documents are scored."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["", "rare "]) * (rng.random() < 0.02) + f"v{rng.randrange(3000)}" for _ in range(rng.choice([20, 60]))) for _ in range(2000)]
    texts += [" ".join(["often"] * k + [f"v{k}"] * 70) for k in range(1, 40)]
    hashes, counts, ends, total = ranked_search.term_counts(pa.array(texts))
    width = 2048
    row = {"doc_ids": list(range(len(texts))), "n": total.tolist(), "ends": ends.tolist(), "hashes": hashes.tobytes(), "counts": counts.astype(np.uint32).tobytes(), "width": width, "slices": ranked_search.signature(hashes, counts, ends, width).tobytes()}
    block = ranked_search.Block(row, len(texts), int(total.sum()))
    asked, _, item_ends, _ = ranked_search.term_counts(pa.array(["rare v7 v8", "often v20", "v1 v2 v3 v4 v5"]))
    terms, of = np.unique(asked, return_inverse=True)
    df = np.array([int((hashes == t).sum()) for t in terms])
    items = ranked_search.Items(terms, item_ends, of, np.floor(1000 * np.log((2.0 * len(texts) + 2) / (2.0 * df + 1))).astype(np.int64))
    for at, bound, _ in block.bounds(items):
        i, d = np.indices(bound.shape).reshape(2, -1)
        assert (block.scores(items, i, d + at) <= bound.ravel()).all()
    best = ranked_search.Best(np.zeros(3, np.int64), 10)
    assert ranked_search.meet(block, items, best) < 0.1 * 3 * len(texts)
    assert len(best.item) == 30


def test_empty_tables(spark):
    docs = edge_docs(spark)
    assert ranked_search.search(empty_docs(spark), bench(spark, ITEMS)).collect() == []
    assert ranked_search.search(docs, bench(spark, [(3, None)])).collect() == []
    assert ranked_search.search(docs, bench(spark, [(5, "?? --"), (4, "")])).collect() == []
    assert ranked_search.search(edge_docs(spark, [(1, None), (2, ""), (3, "--")]), bench(spark, ITEMS)).collect() == []


def test_query_matches_its_oracle(spark):
    status, note = verify.compare(spark, verify.connect("/root/testdata/sf0.01"), "/root/testdata/sf0.01", "op12_ranked_search", queries.ORACLES)
    assert status == "ok", note
