"""Toxicity, language model, licences and decontamination against brute force and held-out rows."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from fixtures import FOLDER, edge_docs, edge_texts, empty_docs, lower, words_of

import verify
from clauselake.llm import decontaminate, language_model, licences, queries, toxicity
from clauselake.llm.common import word_table


def test_word_hashes():
    texts = [t for _, t in edge_texts()]
    hashes, places, first = word_table(pa.array(texts, pa.string()))
    seen = {}
    for k, t in enumerate(texts):
        words = words_of(t or "")
        own = hashes[first[k] : first[k + 1]].tolist()
        assert len(own) == len(words)
        for w, h in zip(words, own, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    model = toxicity.Model(transitions=rng.normal(size=(2, 2)), start=rng.normal(size=2))
    scores, first = rng.normal(size=700) * 3, np.array([0, 5, 5, 300, 301, 700])
    p = toxicity.messages(scores, first, model)[2]
    step = np.exp(model.transitions)
    for a, b in zip(first, first[1:], strict=False):
        e = np.stack([np.ones(b - a), np.exp(scores[a:b])], axis=1)
        f, g = np.zeros((b - a, 2)), np.ones((b - a, 2))
        for t in range(b - a):
            f[t] = (np.exp(model.start) if t == 0 else f[t - 1] @ step) * e[t]
            f[t] /= f[t].sum()
        for t in range(b - a - 2, -1, -1):
            g[t] = step @ (e[t + 1] * g[t + 1])
            g[t] /= g[t].sum()
        if b > a:
            assert np.allclose(p[a:b], (f * g)[:, 1] / (f * g).sum(axis=1), atol=1e-9)


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, folder).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    hits = sum(y and p for y, p in held)
    assert hits >= 0.8 * sum(y for y, _ in held) and hits >= 0.9 * sum(p for _, p in held)


def test_toxicity_spans_and_cases(spark):
    rng, plain = random.Random(6), "all is well with some more words here and you are what your text says of them".split()
    some = lambda n: [rng.choice(plain) for _ in range(n)]
    texts = [(i, " ".join(some(20))) for i in range(60)]
    texts += [(100 + i, " ".join([*some(4), "filthy" + "!" * (i % 3), *some(6), "Filthy", *some(5)])) for i in range(30)]
    labels = [(d, 0, int(d >= 100)) for d, _ in texts] + [(None, 1, 1), (3, 1, None), (5, 1, 0), (5, 1, 0), (999, 1, 1)]
    docs = edge_docs(spark, texts + [(None, "a FILTHY one, filthy"), (500, None), (501, ""), (502, "so filthy and filthy"), (502, "so filthy and filthy")])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "toxicity_", "toxic_spans"]
    rows = scored.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for r in by[502]:
        assert r["toxicity_"] > 0.7 and [r.text[s.start : s.end] for s in r.toxic_spans] == ["filthy", "filthy"]
    assert max(r["toxicity_"] for r in rows if r.doc_id is not None and r.doc_id < 60) < 0.7
    assert by[500][0]["toxicity_"] == by[501][0]["toxicity_"] < 0.5 and by[500][0].toxic_spans == []
    assert len(rows) == docs.count()
    for none in (table.limit(0), table.filter("toxic = 0")):
        assert {r["toxicity_"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.score(empty_docs(spark), model).collect() == []
    assert toxicity.fit(empty_docs(spark), table).logistic is None


def check_language_model(rows, docs):
    tokens = lambda t: [*words_of(t or ""), None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = collections.Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for d, t in docs:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want[d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_language_model_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = queries.op7_language_model(spark, FOLDER).collect()
    check_language_model(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_follow_the_whole_model(spark):
    """Scores against tables seated pair by pair over plain counts of the whole corpus, whatever the places."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40).collect()]
    rows = {r.doc_id: r.score for r in language_model.score(edge_docs(spark, docs), shard_pairs=700, wide=30).collect()}
    texts, flat, hashes = {d: words_of(t or "") for d, t in docs}, {}, word_table(pa.array([t for _, t in docs]))
    for (d, _), a, b in zip(docs, hashes[2], hashes[2][1:], strict=False):
        flat[d] = [int(h) for h in hashes[0][a:b]]
        assert len(flat[d]) == len(texts[d])
    mix = lambda h: int(language_model.mix(np.array([h], np.uint64))[0])
    number = {h: k for k, h in enumerate(sorted({int(language_model.END), *(h for f in flat.values() for h in f)}))}
    told = {d: [number[h] for h in [*f, int(language_model.END)]] for d, f in flat.items()}
    pairs = {d: list(zip([0, *(k + 1 for k in f[:-1])], f, strict=True)) for d, f in told.items()}
    train = [p for d in pairs if zlib.crc32(str(d).encode()) % 5 != 1 for p in pairs[d]]
    count, customers, unigram = collections.Counter(train), collections.Counter(u for u, _ in train), collections.Counter(w for _, w in train)
    every = sorted({p for d in pairs for p in pairs[d]})
    root = dict(zip([w for _, w in every], language_model.root_probability(np.array([unigram[w] for _, w in every]), len(train), len(unigram)), strict=True))
    stirling, theta, discount = language_model.stirling_table(language_model.DISCOUNT), language_model.CONCENTRATION, language_model.DISCOUNT
    one = lambda x, kind: np.array([x], kind)
    tables, p = {}, collections.Counter()
    for sweep in range(language_model.BURN + language_model.SAMPLES):
        x = {u: float(language_model.scale(sweep, one(u, np.uint64), one(customers[u], np.int64), one(tables[u], float) if tables else None)[0]) for u in {u for u, _ in every}}
        t = {(u, w): int(language_model.draw_tables(one(count[u, w], np.int64), one(discount * x[u] * root[w], float), one(mix(u ^ mix(w)), np.uint64), sweep, stirling)[0]) for u, w in every}
        assert all((count[q] > 0) <= t[q] <= count[q] for q in every)
        tables = {u: 0 for u in x}
        for (u, _), k in t.items():
            tables[u] += k
        if sweep >= language_model.BURN:
            for u, w in every:
                p[u, w] += (count[u, w] - discount * t[u, w] + (theta + discount * tables[u]) * root[w]) / (theta + customers[u]) / language_model.SAMPLES
    for d, q in pairs.items():
        assert math.isclose(rows[d], sum(math.log10(p[x]) for x in q), rel_tol=1e-9)


def test_language_model_cases(spark, monkeypatch):
    docs = edge_docs(spark)
    rows = language_model.score(docs).collect()
    check_language_model(rows, edge_texts())
    assert language_model.score(empty_docs(spark)).collect() == []
    # small chunks and shards, and restaurants whose words lie in many places: the same scores
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 2000)
    again = language_model.score(docs, shard_pairs=500, wide=20).collect()
    told = lambda rows: sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in rows)
    assert np.allclose([r[2:] for r in told(again)], [r[2:] for r in told(rows)], rtol=1e-12, atol=0)
    nothing = language_model.score(edge_docs(spark, [(d, "a b") for d in range(200) if zlib.crc32(str(d).encode()) % 5 == 1])).collect()
    assert {(r.train_tokens, r.n_known, round(r.score, 9)) for r in nothing} == {(0, 0, 0.0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_restaurant_probabilities_sum_to_one(seed):
    """Over all known words and the unknown class, for restaurants with few, many and no customers."""
    rng = np.random.default_rng(seed)
    words, groups = 50, 6
    root = rng.dirichlet(np.ones(words + 1))  # the last is the unknown class
    group = np.repeat(np.arange(groups), words + 1)
    c = rng.poisson(rng.choice([0, 0.3, 3, 90], (groups, 1)), (groups, words + 1))
    c[:, -1] = 0
    c[0] = 0
    contexts, words = rng.integers(1, 1 << 62, groups).astype(np.uint64), np.tile(rng.integers(1, 1 << 62, words + 1).astype(np.uint64), groups)
    customers, root = c.sum(axis=1), np.tile(root, groups)
    sums, all_sums = language_model.seatings(contexts, customers, group, words, c.ravel(), root)
    p = language_model.predictive(c.ravel(), sums, all_sums[group], customers[group], root)
    assert np.allclose(np.bincount(group, p), 1)
    assert (p > 0).all()


def test_stirling_numbers_and_tables():
    d = 0.8
    table = language_model.stirling_table(d, 6)
    # S(3, t): seat three customers; weights are products of sizes less d
    assert np.allclose(np.exp(table[3, 1:4]), [(1 - d) * (2 - d), 3 * (1 - d), 1])
    # the sampler's tables follow their exact conditional, the gamma variable its distribution
    rng, n = np.random.default_rng(3), 20_000
    keys = rng.integers(1, 1 << 62, n).astype(np.uint64)
    t = language_model.draw_tables(np.full(n, 3), np.full(n, 0.7), keys, 2, language_model.stirling_table(language_model.DISCOUNT))
    weight = [0.7**k * math.exp(table[3, k]) for k in (1, 2, 3)]
    assert np.allclose(np.bincount(t, minlength=4)[1:] / n, np.array(weight) / sum(weight), atol=0.015)
    for shape in (1.25, 7.0, 300.0):
        x = language_model.gamma(np.full(n, shape), keys, 1)
        assert math.isclose(x.mean(), shape, rel_tol=0.04) and math.isclose(x.var(), shape, rel_tol=0.08)
    # x and one word's tables by turns keep to the law of tables with x integrated out
    theta, root, stirling = language_model.CONCENTRATION, np.full(n, 0.2), language_model.stirling_table(language_model.DISCOUNT)
    t = np.ones(n, np.int64)
    for sweep in range(1, 30):
        x = language_model.scale(sweep, keys, np.full(n, 5), t.astype(float))
        t = language_model.draw_tables(np.full(n, 5), d * x * root, language_model.mix(keys), sweep, stirling)
    weight = np.array([0.2**k * np.prod([theta + d * i for i in range(k)]) * math.exp(stirling[5, k]) for k in range(1, 6)])
    assert np.allclose(np.bincount(t, minlength=6)[1:] / n, weight / weight.sum(), atol=0.015)
    # seated in stretches: about as many tables as one customer after another gives
    draws = lambda at, n: rng.random(len(at))
    seats = language_model.seat(np.array([0, 1, 5000, 3]), np.full(4, 2.0), d, draws)
    assert seats[0] == 0 and seats[1] == 1 and 1 <= seats[3] <= 3
    many = language_model.seat(np.full(400, 5000), np.full(400, 2.0), d, draws).mean()
    plain = np.ones(400)
    for k in range(1, 5000):
        plain += rng.random(400) * (2 + k - d * plain) < 2
    assert math.isclose(many, plain.mean(), rel_tol=0.05)


def capital(key):
    return licences.SENTENCES[key].capitalize() + "."


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = "\n".join(map(capital, ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]))
BSD = list(map(capital, ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse"]))


def test_licences(spark):
    assert all(any(a in s for a in licences.ANCHORS) for s in licences.SENTENCES.values())
    assert {i for _, _, ids in licences.RULES for i in ids} == set(licences.SENTENCES)
    rows = [
        (1, "Intro.\n" + APACHE), (2, " ".join(BSD)), (3, f"{BSD[0]} x. y. {BSD[1]} z. z. z. {BSD[2]}"), (4, None), (5, ""),
        (6, f"{BSD[0]} {BSD[0]} q. {BSD[1]} a. {BSD[2]} Released under the MIT License"), (7, capital("mit-name") + "\n\n" + MIT),
        (None, "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"), (8, "# MIT.\n# Released under\n# the MIT License.\n"),
        (9, f"{BSD[0]} a. b. c. {BSD[1]} {BSD[1]} {BSD[2]}"), (10, "This license is not known."), (2, " ".join(BSD)),
        (11, " ".join(["Licensed under CC BY-NC 4.0."] * 300)),
    ]
    docs = edge_docs(spark, rows)
    got = sorted(map(tuple, licences.scan(docs).collect()), key=str)
    once = [r for r in got if r[0] != 11]
    assert once == sorted([
        (1, "Apache-2.0", "notice-the-license", 5, 2, 7), (2, "BSD-3-Clause", "text", 4, 1, 4), (2, "BSD-3-Clause", "text", 4, 1, 4),
        (6, "BSD-2-Clause", "text", 3, 2, 6), (6, "MIT", "released", 1, 7, 7), (7, "MIT", "titled-text", 5, 1, 5),
        (None, "GPL-3.0", "work", 1, 2, 2), (8, "MIT", "released", 1, 2, 2),
    ], key=str)
    assert len(got) - len(once) == 300
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(licences.oracle()).fetchall(), key=str) == got
    assert licences.scan(empty_docs(spark)).collect() == []


def test_licences_query_matches_its_oracle(spark):
    status, note = verify.compare(spark, verify.connect("/root/testdata/sf0.01"), "/root/testdata/sf0.01", "op8_licences", queries.ORACLES)
    assert status == "ok", note


def test_licence_plan_is_native(spark):
    plan = queries.op8_licences(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def plain_tokens(text):
    """(start, end, word in small letters, type of the first reading, opens a sentence, capitalised word of no other type)."""
    out, end, after_number = [], 0, False
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+(?:[.,][0-9]+)*", text):
        word = m.group()
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        opens = not out or bool(re.search(rb"[.!?\n]", text[end : m.start()]))
        number = word[:1].isdigit()
        unit = after_number and not number and low in [u.encode() for u in decontaminate.UNITS]
        capital = not number and not unit and 65 <= word[0] <= 90 and len(word) > 1 and (97 <= word[1] < 123 or word[1] >= 128)
        kind = "number" if number else "unit" if unit else "name" if capital and not opens else None
        out.append((m.start(), m.end(), low, kind, opens, capital))
        after_number, end = number, m.end()
    return out


def template(text):
    return [(kind, low) for _, _, low, kind, _, _ in plain_tokens(text)]


def second_template(text):
    """Names are capitalised words that are not common, wherever they stand; names in a row are one, named by the first
    that is no title."""
    common, titles = ({w.encode() for w in words} for words in (decontaminate.COMMON, decontaminate.TITLES))
    out, last_end, was_name, was_title, held = [], None, False, False, False
    for start, end, low, kind, opens, capital in plain_tokens(text):
        name = capital and low not in common
        title = name and low in titles
        joins = name and was_name and ((start - last_end == 1 and not opens) or (start - last_end <= 2 and was_title))
        if joins:
            if not held and not title:  # only titles before it
                out[-1] = ("name", low)
                held = True
        else:
            out.append(("name" if name else None if capital else kind, low))
            held = name and not title
        last_end, was_name, was_title = end, name, title
    return out


def plain_leaks(docs, bench, width=5, share=0.8):
    """Covered tokens of each (document, item), by the first reading that finds the pair."""
    found = {}
    for read, shortest in ((template, 1), (second_template, width)):
        for pair, covered in plain_reading(docs, bench, read, shortest, width, share).items():
            found.setdefault(pair, covered)
    return found


def plain_reading(docs, bench, read, shortest, width, share):
    key = lambda ws: tuple(k or w for k, w in ws)
    items, index, found = {}, collections.defaultdict(list), {}
    for i, t in bench:
        x = read((t or "").encode())
        if len(x) >= shortest:
            items[i] = x
            w = min(width, len(x))
            for p in range(len(x) - w + 1):
                index[key(x[p : p + w])].append((i, p))
    for d, t in docs:
        x = read((t or "").encode())
        w = min(width, len(x))
        lines = collections.defaultdict(set)
        for p in range(len(x) - w + 1 if x else 0):
            for i, q in index.get(key(x[p : p + w]), ()):
                if len(items[i]) >= width or len(items[i]) == len(x):
                    lines[i, p - q].add((p, q))
        covered = collections.defaultdict(set)
        for (i, _), pairs in lines.items():
            meets = collections.defaultdict(set)
            slots = lambda p, q: [(items[i][q + k][1], x[p + k][1]) for k in range(w) if items[i][q + k][0]]  # noqa: B023, E731
            for p, q in pairs:
                for was, now in slots(p, q):
                    meets[was].add(now)
            for p, q in pairs:
                if all(len(meets[was]) == 1 for was, _ in slots(p, q)):
                    covered[i] |= set(range(q, q + w))
        for i, c in covered.items():
            if len(c) >= share * len(items[i]):
                found[d, i] = len(c)
    return found


QUESTION = "If Anna buys 12 apples for 3.50 dollars and Anna sells 5 apples, how many does Anna keep after 12 days?"
ASKED = [
    (70001, "Noise here. If Maria buys 40 apples for 7 euros and Maria sells 9 apples, how many does Maria keep after 40 hours? more"),
    (70002, "If Maria buys 40 apples for 7 euros and Peter sells 9 apples, how many does Olga keep after 41 hours?"),
    (70003, "Short! ONE"), (70004, None), (70005, ""), (70006, "x short one y"), (70007, "He said Bob Runs 12 km. Then Bob rests."),
    (70009, "ab 5"), (70010, "km long of it is"), (70011, "5km, 6 kg and 7.5.8 Ärger Élan iPad"), (None, QUESTION.lower()), (70012, QUESTION * 3),
]


@pytest.fixture(scope="module")
def leaks(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()] + ASKED
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs.append((70008, bench[3][1].upper().replace(" ", " !! ")))
    bench += [(900, QUESTION), (901, "short one"), (902, None), (903, "Tom Runs 5 km. Then Tom rests"), (904, ""), (900, QUESTION)]
    return docs, bench, plain_leaks(docs, bench)


def test_decontamination(spark, leaks, monkeypatch):
    docs, bench, want = leaks
    assert {k for k in want if k[0] is not None and k[0] >= 70000} >= {(70001, 900), (70003, 901), (70007, 903), (70008, 3), (70012, 900)}
    assert (70002, 900) not in want
    table, items = edge_docs(spark, docs), spark.createDataFrame(bench, "item_id long, text string")
    rows = decontaminate.find(table, items).collect()
    assert {(r.doc_id, r.item_id): r.covered for r in rows} == want and len(rows) == len(want)
    assert next(r.reparameterised for r in rows if r.doc_id == 70001) and not next(r.reparameterised for r in rows if r.doc_id == 70003)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)  # the join by a shuffle finds the same
    assert {(r.doc_id, r.item_id): r.covered for r in decontaminate.find(table, items).collect()} == want


def test_clean_documents_stay(spark, leaks):
    docs, bench, want = leaks
    table, items = edge_docs(spark, docs), spark.createDataFrame(bench, "item_id long, text string")
    kept = decontaminate.clean(table, items)
    assert kept.schema == table.schema
    bad = {d for d, _ in want}
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(d for d, _ in docs if d not in bad)
    assert decontaminate.clean(empty_docs(spark), items).collect() == []
    assert decontaminate.clean(table, items.limit(0)).count() == len(docs)


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.covered for r in queries.op10_decontamination(spark, FOLDER).collect()}
    assert got == plain_leaks(docs, bench)


def test_random_templates(spark):
    """Random texts of few words, numbers, names and units, cut and exchanged at random."""
    rng = random.Random(8)
    vocabulary = ["the", "a", "of", "Bob", "Ann", "5", "7", "1,000", "km", "kg", ".", "\n", "runs", "far"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, text(rng.randint(3, 14))) for i in range(60)]
    docs = [(i, text(4) + " " + rng.choice(bench)[1].replace("5", rng.choice(["5", "9"])).replace("Bob", rng.choice(["Bob", "Eve"])) + " " + text(5)) for i in range(150)]
    got = decontaminate.find(edge_docs(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.covered for r in got} == plain_leaks(docs, bench)


def number_tables(rng, docs, length, items, asked):
    numbers = lambda n: " ".join(str(rng.randrange(60)) for _ in range(n))
    bench = [(i, numbers(asked)) for i in range(items)] + [(items, "Alpha beats beta by 7 km in all three rounds of 5 games")]
    made = [(d, numbers(length)) for d in range(docs)]
    # copies of an item, as it is and with its numbers exchanged one for one, in the middle of a table
    made[1] = (1, numbers(length // 3) + " " + bench[0][1] + " " + numbers(length // 3))
    made[2] = (2, numbers(length // 4) + " " + " ".join(str(int(n) + 500) for n in bench[1][1].split()) + " " + numbers(9))
    return made + [(docs, "He said: Alpha beats beta by 9 km in all three rounds of 4 games")], bench


def test_tables_of_numbers(spark, monkeypatch):
    """Every window of every table is one template."""
    docs, bench = number_tables(random.Random(3), 6, 150, 4, 25)
    want = plain_leaks(docs, bench)
    assert {(1, 0), (2, 1), (6, 4)} <= set(want)
    items = spark.createDataFrame(bench, "item_id long, text string")
    for at_once in (decontaminate.PAIRS_AT_ONCE, 300):
        monkeypatch.setattr(decontaminate, "PAIRS_AT_ONCE", at_once)
        got = decontaminate.find(edge_docs(spark, docs), items).collect()
        assert {(r.doc_id, r.item_id): r.covered for r in got} == want


def test_rare_windows_keep_candidates_few(spark):
    """Windows that all documents hold meet an item only when it has no others."""
    rng = random.Random(4)
    docs, bench = number_tables(rng, 60, 1500, 20, 120)
    frame = "the model takes 5 steps of 3 km each day and "
    bench.append((99, frame + "rests at Bern after 9 hours with a cup of tea near the old gate"))
    docs += [(100 + i, frame + f"then {i} more words of its own follow here as text {i}") for i in range(40)] + [(500, bench[-1][1])]
    rows = decontaminate.window_rows(spark.createDataFrame(bench, "id long, text string").withColumn("uid", F.xxhash64("id", "text")), None)
    held = spark.createDataFrame(docs, "id long, text string").withColumn("uid", F.xxhash64("id", "text"))
    held = decontaminate.window_rows(held, decontaminate.bit_table(rows)).select("uid", "reading", "window").distinct()
    rare = decontaminate.rare_windows(rows, held.groupBy("window", "reading").agg(F.count("*").alias("n")), 0.8)
    assert held.join(rare, ["window", "reading"]).count() < 5000
    got = decontaminate.find(edge_docs(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(500, 99), (1, 0), (60, 20)} and not any(100 <= r.doc_id < 140 for r in got)


def test_pairs_of_wide_restaurants_are_sent_once(spark, monkeypatch):
    """The rows that their sweeps read are those of the last seating, which sends the other restaurants' rows alone."""
    sent = []
    plain = language_model.pair_rows

    def noted(*args, **kwargs):
        rows = plain(*args, **kwargs)
        sent.append(rows)
        return rows

    monkeypatch.setattr(language_model, "pair_rows", noted)
    language_model.score(edge_docs(spark), shard_pairs=500, wide=20).collect()
    entries = lambda rows: [(r.chunk, r.shard, u) for r in rows.collect() for u in np.cumsum(language_model._unpack(r.contexts, np.uint64), dtype=np.uint64).tolist()]
    found = [set(entries(rows)) for rows in sent]
    assert len(found) == 2 and all(found) and not found[0] & found[1]
