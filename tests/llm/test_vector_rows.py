"""What the vector dedup writes and sends for each vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import vector_dedup


def classes(spark, n, kind, dim=16):
    rng = np.random.default_rng(4)
    rows = [(dim, 1, k, 1, [float(x) for x in rng.normal(size=dim).astype("f4")]) for k in range(n)]
    return spark.createDataFrame(rows, f"dim int, label long, id long, weight long, embedding array<{kind}>")


def test_vectors_are_sent_as_floats_where_floats_hold_them(spark):
    told = vector_dedup.cell_rows(classes(spark, 20, "double"), 0.93).select(F.octet_length("vector").alias("n")).distinct().collect()
    assert [r.n for r in told] == [16 * 4]  # were doubles
    exact = np.array([[0.1, 0.2], [0.5, 0.25]])
    assert [len(r) for r in vector_dedup.packed(exact)] == [16, 8]
    units = vector_dedup.unit_rows(vector_dedup.packed(exact), 2)
    assert np.array_equal(units, vector_dedup.unit_rows([r.tobytes() for r in exact], 2))


@pytest.mark.parametrize("tile", [1000, 60])
def test_a_partner_is_sent_once_for_each_tile_of_homes(spark, monkeypatch, tile):
    """Each was sent once for each tile of all rows of its cell, and once more for the other side."""
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    cells = vector_dedup.cell_rows(classes(spark, 200, "float"), 0.93).cache()
    sizes = cells.groupBy("block", "c0", "c1").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).filter("n > 1 AND h > 0").collect()
    assert max(r.n for r in sizes) > 60
    want = sum(r.n * -(-r.h // tile) + r.h * -(-r.n // tile) for r in sizes)
    assert vector_dedup.tile_rows(cells).count() == want
    cells.unpersist()


def test_cells_are_not_written(spark, monkeypatch):
    names, staged = [], vector_dedup.staged
    monkeypatch.setattr(vector_dedup, "staged", lambda df, name: names.append((name, df.columns)) or staged(df, name))
    rows = spark.createDataFrame([(k, [float(k % 3 + 1), 1.0], 1) for k in range(9)], "vec_id long, embedding array<float>, label int")
    # (2, 1) and (3, 1) have a cosine of 0.99, (1, 1) and (2, 1) one of 0.949, (1, 1) and (3, 1) one of 0.894
    assert sorted(r.n_links for r in vector_dedup.near_duplicates(rows).collect()) == [5] * 6 + [8] * 3
    assert not [n for n, columns in names if "vector" in columns]
