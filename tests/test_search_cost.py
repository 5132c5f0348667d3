"""What a search multiplies and rounds for a query: only what can be among its best."""

import numpy as np
import pyarrow as pa
import pytest

from clauselake.operators import postings, vectors


def _cell(values):
    return np.ascontiguousarray(np.asarray(values, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _block(n, seed, same=False):
    """A block with rare and frequent terms, and their plain postings."""
    rng = np.random.default_rng(seed)
    lengths = np.full(n, 9) if same else rng.integers(1, 40, n)
    block, plain = postings._Block({"chunk_ids": [f"c{i:05d}" for i in range(n)], "clause_ids": [None] * n, "lengths": lengths.tolist()}, 20.0, 1.2, 0.75), {}
    for t, share in enumerate((0.002, 0.05, 0.3, 0.9, 1.0)):
        slots = np.flatnonzero(rng.random(n) < share)
        if len(slots):
            counts = np.ones(len(slots), int) if same else rng.integers(1, 5, len(slots))
            block.add({"term": f"t{t}", "gaps": _cell(np.diff(slots, prepend=0)), "counts": _cell(counts)})
            plain[f"t{t}"] = slots, counts / (counts + 1.2 * (0.25 + 0.75 * lengths[slots] / 20.0))
    return block, plain


def _plain(plain, terms, n, k):
    score = np.zeros(n)
    for t in terms:
        if t["term"] in plain:
            np.add.at(score, plain[t["term"]][0], plain[t["term"]][1] * t["boost"])
    score = np.round(score, 6)
    order = [i for i in np.lexsort((np.arange(n), -score)).tolist() if score[i] > 0][:k]
    return order, score[order]


@pytest.mark.parametrize("n", [1, 5, 63, 64, 700, 5000])
@pytest.mark.parametrize("same", [False, True])
def test_best_of_a_block(n, same):
    block, plain = _block(n, n, same)
    rng = np.random.default_rng(7)
    for _ in range(30):
        terms = [{"term": f"t{j}", "boost": float(b)} for j, b in zip(rng.choice(7, 3, replace=False), rng.choice([1e-8, 0.5, 2.25], 3), strict=True)]
        for k in (1, 10):
            slots, score = block.best(terms, k)
            want, told = _plain(plain, terms, n, k)
            assert slots.tolist() == want and np.allclose(score, told, rtol=0, atol=1e-12)


def test_frequent_terms_need_no_slots():
    """Each posting was looked up and added by itself for every query."""
    block, plain = _block(5000, 3)
    kept = {t: block.terms[t][0] is None for t in plain}
    assert kept == {"t0": False, "t1": False, "t2": True, "t3": True, "t4": True}
    assert all(len(block.terms[t][1]) == 5000 for t in ("t2", "t3", "t4"))


@pytest.mark.parametrize("near", [0.0, 1e-7, 1e-3])
def test_vectors_are_ruled_out_as_floats_and_scored_as_doubles(near):
    rng, dim, k = np.random.default_rng(5), 24, 6
    base = rng.normal(size=(12, dim))
    rows = np.concatenate([base[rng.integers(0, 12, 400)] + near * rng.normal(size=(400, dim)), np.zeros((3, dim)), rng.normal(size=(300, dim))])
    queries = np.concatenate([base, rng.normal(size=(20, dim))])
    centres = np.eye(dim)[:4]
    shelf = [[1, 2, -1], [0.0] * 3, [3.2] * 3, [400, 300, 3]]
    rows = np.concatenate([rows[:400], rows[403:], rows[400:403]])
    names = [f"c{i:04d}" for i in range(len(rows))]
    pack = pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["1"]), pa.array([[f"q{i}" for i in range(len(queries))]]), pa.array([queries.tobytes()], pa.binary())], ["pack", "kb_id", "query_ids", "given"])
    kinds = dict(cells=pa.int32(), lowest=pa.float64(), highest=pa.float64(), sizes=pa.int32())
    batch = pa.RecordBatch.from_arrays([*[pa.array([v], pa.list_(t)) for v, t in zip(shelf, kinds.values(), strict=True)], pa.array([names]), pa.array([names]), pa.array([rows.tobytes()], pa.binary())], [*kinds, "chunk_ids", "clause_ids", "data"])
    held = vectors._Pack(0, pack, 0, dim, centres, k, "<f8")
    assert held.floats.dtype == np.float32
    for prunes in (False, True):
        held = vectors._Pack(0, pack, 0, dim, centres, k, "<f8")
        held.meet(batch, 0, prunes, "<f8")
        found = held.hits().to_pydict()
        score = np.round((1 + vectors.unit_rows(queries) @ vectors.unit_rows(rows).T) / 2, 6)
        for i in range(len(queries)):
            want = np.lexsort((np.arange(len(rows)), -score[i]))[:k].tolist()
            own = [j for j, q in enumerate(found["query_id"]) if q == f"q{i}"]
            assert [found["chunk_id"][j] for j in own] == [names[w] for w in want]
            assert np.allclose([found["score"][j] for j in own], score[i, want], rtol=0, atol=1e-12)
