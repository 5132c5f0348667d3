"""The language model whose root is sampled from the tables that its restaurants send up."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
from fixtures import edge_docs, edge_texts, empty_docs, words_of

from clauselake.llm import language_model as lm
from clauselake.llm.common import word_table


def whole_model(docs):
    """Scores by plain loops over all pairs of the corpus, restaurants and root by turns."""
    hashes = word_table(pa.array([t or "" for _, t in docs]))
    flat = {k: [int(h) for h in hashes[0][a:b]] for k, (a, b) in enumerate(zip(hashes[2], hashes[2][1:], strict=False))}
    number = {h: k for k, h in enumerate(sorted({int(lm.END), *(h for f in flat.values() for h in f)}))}
    told = {k: [number[h] for h in [*f, int(lm.END)]] for k, f in flat.items()}
    pairs = {k: list(zip([0, *(w + 1 for w in f[:-1])], f, strict=True)) for k, f in told.items()}
    train = [p for k in pairs if docs[k][0] is None or zlib.crc32(str(docs[k][0]).encode()) % 5 != 1 for p in pairs[k]]
    count, customers, n = collections.Counter(train), collections.Counter(u for u, _ in train), collections.Counter(w for _, w in train)
    every = sorted({p for k in pairs for p in pairs[k]})
    one = lambda x, kind: np.array([x], kind)
    mix = lambda h: int(lm.mix(one(h, np.uint64))[0])
    words, d, d0, theta, theta0 = len(n), lm.DISCOUNT, lm.ROOT_DISCOUNT, lm.CONCENTRATION, lm.ROOT_CONCENTRATION
    stirling, above = lm.stirling_table(d), lm.stirling_table(d0)
    seated, tables_of, tables, p = dict(n), dict.fromkeys(n, 1), {}, collections.Counter()
    for sweep in range(lm.BURN + lm.SAMPLES):
        mass = (theta0 + d0 * sum(tables_of.values())) / (theta0 + sum(seated.values())) * 0.5
        root = collections.defaultdict(lambda mass=mass: mass)
        root |= {w: (seated[w] - d0 * tables_of[w]) / (theta0 + sum(seated.values())) + mass / words for w in n}
        x = {u: float(lm.scale(sweep, one(u, np.uint64), one(customers[u], np.int64), one(tables[u], float) if tables else None)[0]) for u, _ in every}
        t = {(u, w): int(lm.draw_tables(one(count[u, w], np.int64), one(d * x[u] * root[w], float), one(mix(u ^ mix(w)), np.uint64), sweep, stirling)[0]) for u, w in every}
        tables, up = collections.Counter(), collections.Counter()
        for (u, w), k in t.items():
            tables[u] += k
            up[w] += k
        tops = sum(tables_of.values())
        seated = {w: up[w] for w in n}
        x0 = float(lm.gamma(one(theta0 / d0 + tops, float), one(lm.ROOT, np.uint64), sweep)[0]) if sweep else theta0 / d0 + float(sum(up.values())) ** d0
        tables_of = {w: int(lm.draw_tables(one(up[w], np.int64), one(d0 * x0 * 0.5 / words, float), one(mix(int(lm.ROOT) ^ mix(w)), np.uint64), sweep, above, d0)[0]) for w in n}
        assert all(1 <= tables_of[w] <= up[w] <= n[w] for w in n)
        if sweep >= lm.BURN:
            mass = (theta0 + d0 * sum(tables_of.values())) / (theta0 + sum(up.values())) * 0.5
            now = {w: (up[w] - d0 * tables_of[w]) / (theta0 + sum(up.values())) + mass / words for w in n}
            for u, w in every:
                p[u, w] += (count[u, w] - d * t[u, w] + (theta + d * tables[u]) * now.get(w, mass)) / (theta + customers[u]) / lm.SAMPLES
    return [sum(math.log10(p[x]) for x in q) for q in pairs.values()], seated, n


def test_scores_follow_restaurants_and_root(spark, monkeypatch):
    docs = [(d, t) for d, t in edge_texts() if len(t or "") < 10_000 and d not in (3, 7)]  # ids once
    want, seated, n = whole_model(docs)
    assert sum(seated.values()) < sum(n.values())  # tables are customers of the root, not tokens
    monkeypatch.setattr(lm, "RANGE_WORDS", 1000)
    rows = lm.score(edge_docs(spark, docs), shard_pairs=700, wide=30, held=False).collect()
    told = lambda pairs: [score for _, score in sorted((str(d), score) for d, score in pairs)]
    assert np.allclose(told((r.doc_id, r.score) for r in rows), told(zip((d for d, _ in docs), want, strict=True)), rtol=1e-9, atol=0)


def test_cases_with_a_sampled_root(spark, monkeypatch):
    docs = edge_docs(spark)
    rows = lm.score(docs, held=False).collect()
    told = lambda rows: sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in rows)
    assert len(rows) == len(edge_texts()) and sum(r.n_tokens for r in rows) == sum(len(words_of(t or "")) + 1 for _, t in edge_texts())
    assert lm.score(empty_docs(spark), held=False).collect() == []
    for name, value in (("CHUNK_BYTES", 2000), ("RANGE_WORDS", 50)):
        monkeypatch.setattr(lm, name, value)
    again = lm.score(docs, shard_pairs=500, wide=20, held=False).collect()
    assert np.allclose([r[2:] for r in told(again)], [r[2:] for r in told(rows)], rtol=1e-12, atol=0)
    nothing = lm.score(edge_docs(spark, [(d, "a b") for d in range(200) if zlib.crc32(str(d).encode()) % 5 == 1]), held=False).collect()
    assert {(r.train_tokens, r.n_known, round(r.score, 9)) for r in nothing} == {(0, 0, 0.0)}


def test_root_probabilities_sum_to_one():
    seated, tables = np.array([9, 4, 1, 0]), np.array([3, 1, 1, 0])
    assert math.isclose(lm.root_probability(seated, 14, 3, tables, 5).sum(), 1)
