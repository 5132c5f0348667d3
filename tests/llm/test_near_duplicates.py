"""SimHash, line dedup and vector dedup against brute force."""

import collections
import random

import numpy as np
import xxhash
from fixtures import FOLDER, Union, edge_docs, edge_texts, empty_docs, words_of
from pyspark.sql import functions as F

from clauselake.llm import graph, line_dedup, queries, simhash, vector_dedup


def plain_fingerprint(text):
    words = words_of(text or "")
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    sets, values = Union(len(prints)), np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            sets.join(i, int(j))
    return [sets.find(i) for i in range(len(prints))]


def check_simhash(rows, docs):
    prints = [plain_fingerprint(t) for _, t in docs]
    roots = plain_groups(prints)
    lowest = collections.defaultdict(list)
    for (d, _), r in zip(docs, roots, strict=True):
        lowest[r] += [] if d is None else [d]
    want = collections.Counter((d, f"{p:016x}", min(lowest[r], default=None)) for (d, _), p, r in zip(docs, prints, roots, strict=True))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


def test_simhash_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    check_simhash(queries.op9_simhash(spark, FOLDER).collect(), docs)


def test_simhash_edge_cases(spark):
    check_simhash(simhash.near_duplicates(edge_docs(spark)).collect(), edge_texts())
    assert simhash.near_duplicates(empty_docs(spark)).collect() == []


def test_keep_one_of_each_group(spark):
    docs = edge_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    rows = edge_texts()
    groups = len(set(plain_groups([plain_fingerprint(t) for _, t in rows])))
    assert kept.count() == groups
    assert simhash.keep_one(empty_docs(spark)).collect() == []


def test_links_in_tiles(spark, monkeypatch):
    """Many fingerprints around a few centres share keys; tiles of a few rows find what whole keys do."""
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)}
    values |= {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1, 7, 15}
    values = sorted(values)
    rows = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "bits long")
    roots = plain_groups(values)
    for tile in (4096, 7):
        monkeypatch.setattr(simhash, "TILE", tile)
        found = {r.node: r.component for r in graph.components(simhash.links(rows)).collect()}
        bits = [int(np.uint64(v).view(np.int64)) for v in values]
        by_root, by_component = collections.defaultdict(set), collections.defaultdict(set)
        for b, r in zip(bits, roots, strict=True):
            by_root[r].add(b)
            by_component[found.get(b, b)].add(b)
        assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_component.values()))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (-3, 900), (900, 901)]
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    rng.shuffle(links)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {x: x for p in links for x in p}
    for _ in range(100):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: r for x, r in up.items() if any(x in p and p[0] != p[1] for p in links)}


def plain_lines(rows, least=line_dedup.MIN_WORDS):
    """rows: (doc_id, uid, text). The (doc_id, uid, line) that stay."""

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < least:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    order = lambda p: (p[0] is not None, p[0] or 0, *p[1:])  # noqa: E731  null ids first
    first = {}
    for place, words in sorted(
        (((d, u, i), tuple(words_of(line))) for d, u, t in rows for i, line in enumerate((t or "").split("\n"))), key=lambda x: order(x[0])
    ):
        if words:
            first.setdefault(words, place)
    return {p for w, p in first.items() if not any(order(q) < order(p) and near(v, w) for v, q in first.items())}


def test_line_dedup_brute_force(spark):
    docs = edge_docs(spark).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    rows = [(r.doc_id, r.uid, r.text) for r in docs.collect()]
    want = plain_lines(rows)
    assert {tuple(r) for r in line_dedup.first_lines(docs).collect()} == want
    assert len(want) < len({w for _, _, t in rows for w in (t or "").split("\n") if w.strip()})


def test_line_dedup_texts(spark):
    docs = edge_docs(spark)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines_", "n_removed"]
    named = docs.withColumn("u", F.xxhash64("doc_id", "text")).select("doc_id", "u", "text")
    rows = [tuple(r) for r in named.collect()]
    stay = plain_lines(rows)
    want = collections.Counter()
    for d, u, t in rows:
        lines = [x for i, x in enumerate((t or "").split("\n")) if (d, u, i) in stay or not words_of(x)]
        want[d, None if t is None else "\n".join(lines)] += 1
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert line_dedup.dedup_lines(empty_docs(spark)).collect() == []


def test_line_dedup_through_shuffles(spark, monkeypatch):
    """Beyond the sizes that are broadcast the result is the same."""
    docs = edge_docs(spark).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    want = {tuple(r) for r in line_dedup.first_lines(docs).collect()}
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_DOCUMENTS", 0)
    assert {tuple(r) for r in line_dedup.first_lines(docs).collect()} == want


def test_line_dedup_query(spark):
    docs = [(r.doc_id, 0, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    stay = plain_lines(docs)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, 0, i) in stay or not words_of(x)) for d, _, t in docs}
    assert {r.doc_id: r.text for r in queries.op6_line_dedup(spark, FOLDER).collect()} == want


def test_within_one_edit():
    a = np.arange(12, dtype=np.uint64)
    assert line_dedup.within_one(a, a) and line_dedup.within_one(a, a[1:]) and line_dedup.within_one(np.delete(a, 5), a)
    changed = a.copy()
    changed[4] = 99
    assert line_dedup.within_one(a, changed) and not line_dedup.within_one(np.delete(a, 0), changed)
    assert not line_dedup.within_one(a, a[2:])


def plain_vectors(rows, cosine):
    def good(v, label, i):
        return i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    sets, links = Union(len(rows)), [0] * len(rows)
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v, y, i) else None for i, v, y in rows]
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine:
                links[a] += 1
                links[b] += 1
                sets.join(a, b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[sets.find(k)] = min(i, low.get(sets.find(k), i))
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = low.get(sets.find(k))
        out.append((i, links[k], c, None if i is None else i == c))
    return collections.Counter(out)


def vector_rows(spark):
    base = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()][:200]
    rng, rows = np.random.default_rng(1), list(base)
    for k in range(150):
        i = int(rng.integers(len(base)))
        noise = rng.normal(size=64) * rng.choice([0, 0.01, 0.03, 0.045, 0.06])
        rows.append((1000 + k, [float(x) for x in (np.array(base[i][1]) + noise).astype("f4")], base[i][2]))
    one = base[0]
    rows += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] + [1.0] * 63, 1), (2003, [None] + [1.0] * 63, 1), (2004, one[1], None), (None, one[1], one[2])]
    rows += [(one[0], base[5][1], one[2]), (one[0], one[1], one[2]), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [3.0], 1), (2008, [4.0], 1), (2009, [], 1)]
    rows += [(2011, [1e38] * 64, 2), (2012, [1e38] * 64, 2), (2013, [float("inf")] * 64, 2), (2014, [-0.0] * 63 + [1.0], 3), (2015, [0.0] * 63 + [1.0], 3)]
    return rows


def test_vectors_brute_force(spark, monkeypatch):
    rows = vector_rows(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit(1)).withColumn("id", F.lit(2))
    want = plain_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()], 0.93)
    assert collections.Counter(map(tuple, vector_dedup.near_duplicates(df).collect())) == want
    monkeypatch.setattr(vector_dedup, "TILE", 16)  # several tiles a cell
    assert collections.Counter(map(tuple, vector_dedup.near_duplicates(df).collect())) == want
    assert vector_dedup.near_duplicates(df.limit(0)).collect() == []


def test_vectors_query(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert collections.Counter(map(tuple, queries.op5_vector_dedup(spark, FOLDER).collect())) == plain_vectors(rows, 0.93)
