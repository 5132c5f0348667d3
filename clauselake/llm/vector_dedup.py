"""Embedding near-duplicates by a subspace pigeonhole join.

Normalised vectors with a cosine of at least c are within squared distance 2 - 2c. They are rotated (a fixed random
rotation spreads the distance evenly) and split into blocks; a pair within the whole budget is within its share of the
budget in one block at least. Each block is range-joined on a grid: cells twice as wide as the block's radius, over the
block's first coordinates. A vector is at home in one cell and visits the neighbouring cells that its radius reaches, so
the partners of a home vector are in its cell. Pairs within a block's budget are verified exactly, by the cosine in
double precision, and counted in the first block whose budget they meet.

Cells are cut into tiles of bounded size, homes against all; a tile returns counts and one link for each vector, never
its pairs. Equal vectors of one label are one class and are compared once. Cells are counted first, from their keys
alone, and made again when their rows go to the tiles: vectors are shuffled once, as floats where floats hold them, and
not written. Homes and partners are cut by their own numbers, so a partner is sent once unless its cell has more than
``TILE`` homes.

Cases: a vector that is null, zero, or holds a null or non-finite component links with nothing, nor does one whose label
or vec_id is null; vectors of different lengths never link; rows that repeat a vec_id count as other vectors to one
another when they link; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import small_side, staged
from clauselake.llm.graph import components, local_star, whole_groups

COSINE, BLOCKS, GRID = 0.93, 4, 2
#: vectors of one side of a tile, and home vectors and partners compared at once
TILE, SLAB, STRETCH = 16_384, 256, 4096
#: cells up to which their numbers of tiles are sent to every task
FEW_CELLS = 100_000
_CELLS = "dim int, label long, block int, c0 int, c1 int, home boolean, id long, weight long, vector binary"
_KEYS = ["dim", "label", "block", "c0", "c1"]


def rotation(dim: int) -> np.ndarray:
    """A fixed rotation of the space, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int = BLOCKS) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).astype(int)


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row as floats where they hold it exactly, else as doubles."""
    with np.errstate(over="ignore"):
        small = rows.astype(np.float32)
    exact = (small == rows).all(axis=1)
    return [(f if e else r).tobytes() for f, r, e in zip(small, rows, exact.tolist(), strict=True)]


def unit_rows(raw: list[bytes], dim: int) -> np.ndarray:
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    x = np.empty((len(raw), dim))
    for kind in (np.float32, np.float64):
        at = np.flatnonzero(sizes == dim * np.dtype(kind).itemsize)
        x[at] = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), kind).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths of very large or small components neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cell_rows(classes: DataFrame, cosine: float) -> DataFrame:
    """Every class at home in one cell of each block and as a visitor in the cells that its radius reaches."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                lists = part.column("embedding")
                raw = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                vectors = packed(raw)
                turned = unit_rows(vectors, dim) @ rotation(dim)
                edges = block_edges(dim)
                radius = np.sqrt((2 - 2 * cosine) / (len(edges) - 1)) + 1e-9
                for k, (a, b) in enumerate(itertools.pairwise(edges)):
                    y = turned[:, a : min(a + GRID, b)]
                    y = np.pad(y, ((0, 0), (0, GRID - y.shape[1])))
                    home = np.floor(y / (2 * radius)).astype(np.int64)
                    for shift in itertools.product((-1, 0, 1), repeat=GRID):
                        # distance from the point to the neighbouring cell, zero along axes without a shift
                        s = np.array(shift)
                        near = np.where(s < 0, y - home * 2 * radius, np.where(s > 0, (home + 1) * 2 * radius - y, 0.0))
                        who = np.flatnonzero((near**2).sum(axis=1) <= radius**2)
                        if not len(who):
                            continue
                        cell, take = home[who] + s, pa.array(who)
                        columns = [part.column("dim").take(take), part.column("label").take(take), pa.array(np.full(len(who), k), pa.int32()), pa.array(cell[:, 0], pa.int32()), pa.array(cell[:, 1], pa.int32()), pa.array(np.full(len(who), not any(shift))), part.column("id").take(take), part.column("weight").take(take), pa.array([vectors[i] for i in who], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["dim", "label", "block", "c0", "c1", "home", "id", "weight", "vector"])

    return classes.mapInArrow(place, _CELLS)


def tile_rows(cells: DataFrame) -> DataFrame:
    """The rows of each tile (i, j) of a cell: homes (``left``) and their partners."""
    sizes = cells.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).filter("n > 1 AND homes > 0")
    sizes = sizes.select(*_KEYS, F.ceil(F.col("homes") / TILE).alias("home_tiles"), F.ceil(F.col("n") / TILE).alias("tiles"))
    sizes = small_side(staged(sizes, "cell-sizes"), FEW_CELLS)
    rows, own = cells.join(sizes, _KEYS), F.xxhash64("id")
    every = lambda tiles: F.sequence(F.lit(0).cast("long"), F.col(tiles) - 1)
    # a home row meets all tiles of partners, every row is a partner of all home tiles; each row is made once for both
    places = F.transform(every("home_tiles"), lambda i: F.struct(i.alias("i"), F.pmod(own, F.col("tiles")).alias("j"), F.lit(False).alias("left")))
    homes = F.transform(every("tiles"), lambda j: F.struct(F.pmod(own, F.col("home_tiles")).alias("i"), j.alias("j"), F.lit(True).alias("left")))
    places = F.when(F.col("home"), F.concat(places, homes)).otherwise(places)
    return rows.select(*_KEYS, "id", "weight", "vector", F.explode(places).alias("p")).select(*_KEYS, "p.*", "id", "weight", "vector")


def tile_links(cells: DataFrame, cosine: float) -> DataFrame:
    """Of each tile: (a, b, weight): ``weight`` other vectors link with a there; b is the root of a's links in the tile."""
    keys = [*_KEYS, "i", "j"]
    tiles = tile_rows(cells).repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, keys):
            borders = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for a, b in itertools.pairwise(borders.tolist()):
                found = one_tile(table.slice(a, b - a), cosine)
                if found is not None:
                    yield found

    return tiles.mapInArrow(compare, "a long, b long, weight long")


def one_tile(table: pa.Table, cosine: float) -> pa.RecordBatch | None:
    left = table.column("left").to_numpy().astype(bool)
    if left.all() or not left.any():
        return None
    ids, weights = table.column("id").to_numpy(), table.column("weight").to_numpy()
    dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
    unit = unit_rows(table.column("vector").to_pylist(), dim)
    turned, edges = unit @ rotation(dim), block_edges(dim)
    share = (2 - 2 * cosine) / (len(edges) - 1) + 1e-9
    home, other = np.flatnonzero(left), np.flatnonzero(~left)
    from_, to = edges[block], edges[block + 1]
    partners = turned[other, from_:to]
    square = np.einsum("ij,ij->i", partners, partners)
    count = np.zeros(len(ids), np.int64)
    links = np.zeros((2, 0), np.int64)
    for at, far in itertools.product(range(0, len(home), SLAB), range(0, len(other), STRETCH)):
        slab, against = home[at : at + SLAB], slice(far, far + STRETCH)
        mine = turned[slab, from_:to]
        gap = square[None, against] + np.einsum("ij,ij->i", mine, mine)[:, None] - 2 * mine @ partners[against].T
        x, y = np.nonzero((gap <= share + 1e-9) & (ids[slab][:, None] < ids[other[against]][None, :]))
        x, y = slab[x], other[against][y]
        if not len(x):
            continue
        for part in range(0, len(x), 200_000):  # verify exactly; earlier blocks have counted what meets their share
            p, q = x[part : part + 200_000], y[part : part + 200_000]
            near = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
            p, q = p[near], q[near]
            gaps = (turned[p] - turned[q]) ** 2
            for k in range(block):
                new = gaps[:, edges[k] : edges[k + 1]].sum(axis=1) > share
                p, q, gaps = p[new], q[new], gaps[new]
            np.add.at(count, p, weights[q])
            np.add.at(count, q, weights[p])
            links = np.concatenate([links, np.stack([ids[p], ids[q]])], axis=1)
        links = np.stack(local_star(links[0], links[1]))
    if not links.shape[1]:
        return None
    some = np.flatnonzero(count)
    root = dict(zip(links[0].tolist(), links[1].tolist(), strict=True))
    a = ids[some]
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array([root.get(i, i) for i in a.tolist()], pa.int64()), pa.array(count[some])], ["a", "b", "weight"]
    )


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    usable = usable & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    # -0.0 and 0.0 are one value; the class of a row is its label and its exact vector
    exact = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("embedding", exact)
    good = rows.filter("usable").withColumn("key", F.xxhash64("label", "embedding"))
    classes = good.groupBy("key", "label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    classes = staged(classes.withColumn("dim", F.size("embedding")), "classes")
    # classes that share their smallest vec_id (a repeated vec_id) are told apart by numbers of their own
    number = F.xxhash64("key", "id", "dim")
    named = classes.select("dim", "label", number.alias("id"), "weight", "embedding")
    found = staged(tile_links(cell_rows(named, cosine), cosine), "tile-links")
    groups = components(found.select("a", "b").filter("a != b"))
    counts = found.groupBy("a").agg(F.sum("weight").alias("other"))
    classes = classes.select("key", "label", "embedding", "id", "weight", number.alias("number"))
    joined = classes.join(groups, classes["number"] == groups["node"], "left").join(counts, classes["number"] == counts["a"], "left")
    joined = joined.withColumn("root", F.coalesce("component", "number"))
    lowest = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    joined = joined.join(lowest, "root").select("key", "label", "embedding", "weight", "component_id", F.coalesce("other", F.lit(0)).alias("other"))
    linked = good.join(joined, ["key", "label", "embedding"]).select(
        "vec_id", (F.col("weight") - 1 + F.col("other")).alias("n_links"), "component_id"
    )
    alone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
