"""What a search sends grows with its queries and its index, not with their product."""

import zlib

import numpy as np

from clauselake.operators import postings, vectors


def test_a_pack_leaves_its_best_of_all_shelves_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 8)
    monkeypatch.setattr(vectors, "SHELF_VECTORS", 40)
    rng = np.random.default_rng(2)
    chunks = spark.createDataFrame(
        [(f"c{i}", "k", None, "x", [float(x) for x in rng.normal(size=6)]) for i in range(300)],
        "chunk_id string, kb_id string, canonical_id string, content string, vector array<float>",
    )
    queries = spark.createDataFrame([(f"q{i}", "k", "x", [float(x) for x in rng.normal(size=6)]) for i in range(50)], "query_id string, kb_id string, text string, vector array<float>")
    index = vectors.vector_index(chunks)
    assert index.number > 5 and index.most_blocks > 100
    assert vectors._searched(queries, index, 3).count() == 50 * 3
    assert vectors.knn_hits(queries, index, 3).count() == 50 * 3


def test_groups_of_queries_stay_few():
    """Each group has its own copy of the postings: 135,000 queries had 264 copies."""
    assert postings.query_groups(135_000, 2) == 32
    assert postings.query_groups(810_000, 5) == 25
    assert postings.query_groups(200, 30) == 1 and postings.query_groups(0, 0) == 1


def test_blocks_are_bounded_by_their_text(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_BYTES", 1000)
    chunks = spark.range(20).selectExpr("CONCAT('c', id) AS chunk_id", "'k' AS kb_id", "CAST(NULL AS STRING) AS canonical_id", "REPEAT('alpha beta ', 50) AS content")
    assert postings.postings_index(chunks).most_blocks > 5


def test_vectors_are_kept_in_their_own_precision(spark):
    """They were written and sent as doubles at length one, twice what a table of floats holds."""
    rows = [(f"c{i}", "k", None, "x", [float(i + 1), 2.0, -1.0]) for i in range(20)]
    names = "chunk_id string, kb_id string, canonical_id string, content string, vector array<{}>"
    for kind, size in (("float", 4), ("double", 8)):
        index = vectors.vector_index(spark.createDataFrame(rows, names.format(kind)))
        assert index.shelves.selectExpr("SUM(OCTET_LENGTH(data)) AS n").first()["n"] == 20 * 3 * size
        hit = vectors.knn_hits(spark.createDataFrame([("q", "k", "x", [7.0, 2.0, -1.0])], f"query_id string, kb_id string, text string, vector array<{kind}>"), index, 1).first()
        assert (hit["chunk_id"], hit["score"]) == ("c6", 1.0)


def test_postings_are_small_numbers_byte_by_byte(spark):
    """Slots were 32-bit numbers, which hardly shrink; each group of queries has a copy."""
    chunks = spark.range(3000).selectExpr("CONCAT('c', id) AS chunk_id", "'k' AS kb_id", "CAST(NULL AS STRING) AS canonical_id", "CONCAT('alpha ', IF(id % 700 = 0, 'rare', 'x')) AS content")
    rows = {r["term"]: r for r in postings.postings_index(chunks).rows.filter("term IS NOT NULL").collect()}
    assert len(zlib.compress(rows["alpha"]["gaps"])) + len(zlib.compress(rows["alpha"]["counts"])) < 200
    slots = np.cumsum(postings._values(rows["rare"]["gaps"]))
    every = sorted(f"c{i}" for i in range(3000))
    assert [every[s] for s in slots] == sorted(f"c{i}" for i in range(0, 3000, 700))
    values, ends = np.array([5, 70_000, 2**32 - 1, 0, 256]), np.array([0, 1, 1, 4, 5])
    assert [postings._values(c.as_py()).tolist() for c in postings._binary(values, ends)] == [[5], [], [70_000, 2**32 - 1, 0], [256]]


def test_a_task_holds_a_block_of_eight_megabytes(spark):
    """Blocks of 16 MB of text made a worker's memory half as large again."""
    chunks = spark.range(900).selectExpr("CONCAT('c', id) AS chunk_id", "'k' AS kb_id", "CAST(NULL AS STRING) AS canonical_id", "REPEAT('alpha beta ', 1000) AS content")
    assert postings.postings_index(chunks).most_blocks == 2
