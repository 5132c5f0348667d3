"""The mix against sorted running sums, its targets against a plain water level, and its texts."""

import collections
import hashlib
import math
import random

import pytest

import verify
from clauselake.llm import mixing, queries

from fixtures import FOLDER, edge_docs, empty_docs


def n_words(text):
    return len((text or "").encode().split())


def plain_targets(sizes, weights=mixing.WEIGHTS, share=mixing.SHARE, repeats=mixing.REPEATS):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, budget = set(), share * sum(sizes.values())
    while True:
        left = [s for s in order if s not in capped]
        level = (budget - sum(repeats * sizes[s] for s in capped)) / max(1e-300, sum(weight[s] for s in left))
        above = {s for s in left if level * weight[s] > repeats * sizes[s]}
        if not above:
            return {s: repeats * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= above


def plain_mix(docs, **how):
    """docs: (source, doc_id, text). Per row its taken words, as a multiset of (source, doc_id, size, taken)."""
    sizes = collections.Counter()
    for s, _, t in docs:
        sizes[s] += n_words(t)
    goal, out = plain_targets(sizes, **how), collections.Counter()
    for s in sizes:
        rows = collections.defaultdict(list)
        for src, d, t in docs:
            if src == s:
                key = hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).hexdigest()[:15]
                rows[key].append((d, n_words(t)))
        budget = math.floor(goal[s])
        whole, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for key in sorted(rows):
            words = sum(n for _, n in rows[key])
            here = max(0, min(words, rest))
            for d, n in rows[key]:
                out[s, d, n, whole * n + (n * here // words if words else 0)] += 1
            rest -= words
    return out, goal


def without_source(rows):
    return collections.Counter(key[1:] for key in rows.elements())


def table(spark, rows):
    return spark.createDataFrame(rows, "source string, doc_id long, text string")


def as_rows(spark, docs):
    return [(r.source, r.doc_id, r.text) for r in docs.select("source", "doc_id", "text").collect()]


def test_edge_texts(spark):
    docs = edge_docs(spark)
    rows = as_rows(spark, docs)
    want, goal = plain_mix(rows)
    got = mixing.mix_sizes(docs.select("doc_id", "text", "source"))
    found = got.collect()
    assert collections.Counter((r.doc_id, r.size, r.taken) for r in found) == without_source(want)
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part for r in found)
    assert sum(r.taken for r in found) == pytest.approx(sum(goal.values()), abs=len(rows))


@pytest.mark.parametrize("share", [0.3, 1.5, 1.9, 2.5])
def test_random_sources(spark, share):
    """Null and empty sources, one with a third of all rows, rows of equal id and text, a source without words."""
    rng = random.Random(int(share * 10))
    names = [None, "", "a", "B", "é", "漢", "zz", "none"]
    rows = []
    for i in range(600):
        s = "a" if i % 3 == 0 else rng.choice(names[:-1])
        rows.append((s, i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 200 if s != "zz" else 5]))))
    rows += [("B", 7, "one two three")] * 30 + [(None, None, "x y")] * 9 + [("none", 1, None), ("none", 2, " \t")]
    want, goal = plain_mix(rows, share=share)
    got = mixing.mix_sizes(table(spark, rows), share=share).collect()
    assert collections.Counter((r.doc_id, r.size, r.taken) for r in got) == without_source(want)
    assert {round(r.target, 6) for r in got} == {round(float(g), 6) for g in goal.values()}
    assert sum(r.taken for r in got) == pytest.approx(sum(goal.values()), abs=40)


def test_reruns_agree_and_budgets_are_nested(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    taken = lambda df: {r.doc_id: r.taken for r in df.collect()}
    first = taken(mixing.mix_sizes(docs))
    assert first == taken(mixing.mix_sizes(docs.repartition(7)))
    more = taken(mixing.mix_sizes(docs, share=1.7))
    assert all(more[d] >= first[d] for d in first) and sum(more.values()) > sum(first.values())


def test_texts_of_the_mix(spark):
    rows = [("a", i, f"word{i}  two\nthree {'x ' * i}") for i in range(30)] + [("b", 99, "some  few words"), (None, 500, None)]
    docs = table(spark, rows).selectExpr("*", "'c' AS copy", "1 AS size")
    mixed = mixing.mix(docs).collect()
    sizes = {r.doc_id: (r.copies, r.part, r.size) for r in mixing.mix_sizes(docs).collect()}
    texts = {d: t for _, d, t in rows}
    per = collections.defaultdict(list)
    for r in mixed:
        per[r.doc_id].append(r)
    for d, (copies, part, _) in sizes.items():
        have = sorted(per.get(d, []), key=lambda r: r.copy_)
        assert [r.copy_ for r in have] == list(range(1, copies + (part > 0) + 1))
        assert all(r.text == texts[d] and r.copy == "c" for r in have[:copies])
        assert all(r.text.split() == texts[d].split()[:part] for r in have[copies:])


def test_empty_table(spark):
    assert mixing.mix_sizes(empty_docs(spark)).collect() == []
    assert mixing.mix(empty_docs(spark)).collect() == []
    blank = table(spark, [("a", 1, None), (None, None, " ")])
    assert [(r.size, r.taken, r.target) for r in mixing.mix_sizes(blank).collect()] == [(0, 0, 0.0)] * 2


def test_query_matches_its_oracle(spark):
    status, note = verify.compare(spark, verify.connect("/root/testdata/sf0.01"), "/root/testdata/sf0.01", "op11_mixing", queries.ORACLES)
    assert status == "ok", note
