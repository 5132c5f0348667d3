"""Vector retrieval over a written index of cells.

Vectors are kept as they are given, in their own precision, and compared at length one. A cell holds the vectors of a knowledge base that are nearest to one centre; in the order
of their angles to the centre they are cut into blocks. A block knows its lowest and highest angle, so the triangle
inequality of angles bounds the cosine of any query with any vector of the block. Neighbouring blocks share a row, a shelf.

A search packs queries of neighbouring cells and meets packs and shelves by a replicating join: neither is shuffled, a
task goes through a pack's shelves one after the other and keeps the best ``k`` a query, so what leaves a task grows with
the queries alone. Blocks are taken by their bounds, best first; a block is compared with those queries of a pack whose
k-th score its bound still reaches. The result is that of comparing all vectors. Centres are fitted on a bounded sample;
they decide how much is skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.operators.ordered import top_rows
from clauselake.operators.postings import clause_of
from clauselake.runtime import ship_by_value, written

ship_by_value(__name__)

#: vectors for each fourth of a centre and at most in four blocks, vectors of a shelf, shelves that a task goes through
BLOCK_VECTORS, SHELF_VECTORS, SHELVES_PER_TASK = 2048, 16_384, 8
#: vectors the centres are fitted on, centres at most, rounds of fitting
SAMPLE, MOST_CENTRES, ROUNDS = 8192, 256, 6
#: queries of a pack at most, and from how many on a further task is worth it
QUERY_GROUP, LEAST_GROUP = 2048, 256
#: shelves' blocks a knowledge base beyond which blocks are skipped by their bounds
PRUNE_FROM = 16
PLACES, SLACK = 6, 2e-6
#: pairs of a query and a vector that are multiplied as doubles at once
AT_ONCE = 65_536
#: the cell of vectors of length zero: they have no angle, so nothing skips them
NO_CELL = -1

SHELVES = (
    "kb_id string, cells array<int>, lowest array<double>, highest array<double>, sizes array<int>, n long, "
    "chunk_ids array<string>, clause_ids array<string>, data binary"
)
_SHELF = pa.schema([("kb_id", pa.string()), ("cells", pa.list_(pa.int32())), ("lowest", pa.list_(pa.float64())), ("highest", pa.list_(pa.float64())), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("chunk_ids", pa.list_(pa.string())), ("clause_ids", pa.list_(pa.string())), ("data", pa.binary())])


@dataclass(frozen=True)
class VectorIndex:
    shelves: DataFrame  # SHELVES
    centres: np.ndarray
    dim: int
    precision: str  # of what is kept
    number: int  # of shelves
    most_blocks: int


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; a zero row stays zero."""
    m = np.asarray(vectors, np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def fit_centres(rows: np.ndarray, number: int) -> np.ndarray:
    """Spherical k-means of unit rows, from evenly spread ones."""
    found = rows[np.linspace(0, len(rows) - 1, min(number, len(rows))).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(rows @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, rows)
        length = np.sqrt(np.einsum("ij,ij->i", sums, sums))[:, None]
        found = np.where(length > 0, sums / np.maximum(length, 1e-300), found)
    return found


def _precision(rows: DataFrame) -> str:
    """How the components of ``vector`` are kept."""
    return "<f4" if rows.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(flat) != len(column) * dim or pc.any(pc.not_equal(pc.list_value_length(column), dim)).as_py():
        raise ValueError(f"all vectors of an index and its queries have {dim} components")
    return flat.reshape(-1, dim)


def angles_to(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centres.T, -1.0, 1.0))


def vector_index(chunks: DataFrame) -> VectorIndex:
    """Index the vectors of ``chunks`` (``chunk_id, kb_id, canonical_id, vector``); null vectors are left out."""
    rows = chunks.filter(F.col("vector").isNotNull()).select(
        F.col("chunk_id").cast("string"), F.col("kb_id").cast("string"), clause_of(chunks).alias("clause_id"), "vector"
    )
    total, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    dim, precision = dim or 0, _precision(rows)
    number = min(MOST_CENTRES, 4 * total // BLOCK_VECTORS) if total > BLOCK_VECTORS else 1
    centres = np.zeros((1, dim))
    if number > 1:
        sample = rows.select("vector").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).collect()
        centres = fit_centres(unit_rows(np.array([r[0] for r in sample]).reshape(-1, dim)), number)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = _matrix(batch.column("vector"), dim, precision)
            unit = unit_rows(given)
            angle = angles_to(unit, centres)
            cell = np.argmin(angle, axis=1)
            own = angle[np.arange(len(cell)), cell]
            cell = np.where(unit.any(axis=1), cell, NO_CELL)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell, pa.int32()), pa.array(own), _binary_rows(given)], ["chunk_id", "kb_id", "clause_id", "cell", "angle", "given"])

    placed = written(rows.mapInArrow(place, "chunk_id string, kb_id string, clause_id string, cell int, angle double, given binary"), "placed-vectors")
    order = ["kb_id", "cell", "angle", "chunk_id"]
    shelved = placed.repartitionByRange(max(1, -(-total // SHELF_VECTORS)), *order).sortWithinPartitions(*order)
    most, shelf = max(1, BLOCK_VECTORS // 4), SHELF_VECTORS

    def shelve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "kb_id", shelf):
            yield _shelf(table, most)

    shelves = written(shelved.mapInArrow(shelve, SHELVES), "vector-shelves")
    count = shelves.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cells")).alias("blocks")).agg(F.sum("n"), F.max("blocks")).first()
    return VectorIndex(shelves, centres, dim, precision, count[0] or 0, count[1] or 0)


def _binary_rows(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as a binary cell."""
    raw = np.ascontiguousarray(rows)
    ends = np.arange(len(raw) + 1, dtype=np.int64) * (raw.shape[1] * raw.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def runs(batches: Iterable[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Consecutive rows with an equal ``key``, at most ``most`` at a time."""
    held, size = [], 0
    for batch in batches:
        keys = batch.column(key)
        for start, stop in _stretches(keys):
            while start < stop:
                if held and (size == most or held[0].column(key)[0] != keys[start]):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                take = min(stop - start, most - size)
                held.append(batch.slice(start, take))
                start, size = start + take, size + take
    if held:
        yield pa.Table.from_batches(held)


def _stretches(keys: pa.Array) -> list[tuple[int, int]]:
    if not len(keys):
        return []
    code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(code)], strict=True))


def _shelf(table: pa.Table, most: int) -> pa.RecordBatch:
    """One shelf of rows in the order of cells and angles; a block holds at most ``most`` vectors of a cell."""
    cell, angle = table.column("cell").to_numpy(), table.column("angle").to_numpy()
    opens = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
    starts = np.concatenate([np.arange(a, b, most) for a, b in zip(opens, [*opens[1:], len(cell)], strict=True)])
    cells, own = cell[starts], np.diff([*starts, len(cell)])
    lowest, highest = np.minimum.reduceat(angle, starts), np.maximum.reduceat(angle, starts)
    data = b"".join(table.column("given").to_pylist())
    ids = [table.column(c).to_pylist() for c in ("chunk_id", "clause_id")]
    row = [table.column("kb_id")[0].as_py(), cells.tolist(), lowest.tolist(), highest.tolist(), own.tolist(), len(cell), *ids, data]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SHELF, strict=True)], schema=_SHELF)


# ---- search ----------------------------------------------------------------
def knn_hits(queries: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """Exact cosine top ``k`` inside the query's ``kb_id``: ``query_id, chunk_id, clause_id, score, rank``; score is ``(1 + cos) / 2``."""
    return _best(_searched(queries, index, k), k).select("query_id", "chunk_id", "clause_id", "score", "rank")


def compared_share(queries: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """Per query: ``compared`` vectors, ``total`` vectors of its knowledge base, and ``share``."""
    total = index.shelves.groupBy("kb_id").agg(F.sum("n").alias("total"))
    done = _searched(queries, index, k, report=True).groupBy("query_id", "kb_id").agg(F.sum("compared").alias("compared")).join(total, "kb_id")
    return done.select("query_id", "compared", "total", (F.col("compared") / F.col("total")).alias("share"))


def _packs(queries: DataFrame, index: VectorIndex) -> DataFrame:
    """Queries with a vector in packs of one knowledge base and neighbouring cells, written: ``pack, kb_id, query_ids, given``."""
    # an index without vectors answers nothing, and a query without an id has no answer
    rows = queries.filter(F.col("vector").isNotNull() & F.col("query_id").isNotNull() & F.lit(index.dim > 0)).select("query_id", F.col("kb_id").cast("string").alias("kb_id"), "vector")
    kind = rows.schema["query_id"].dataType.simpleString()
    dim, precision, centres, spark = index.dim, _precision(rows), index.centres, queries.sparkSession

    def turn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = _matrix(batch.column("vector"), dim, precision)
            cell = np.argmin(angles_to(unit_rows(given), centres), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("kb_id"), pa.array(cell, pa.int32()), _binary_rows(given)], ["query_id", "kb_id", "cell", "given"])

    turned = written(rows.mapInArrow(turn, f"query_id {kind}, kb_id string, cell int, given binary"), "asked-vectors")
    number, different = turned.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    if number > different:  # of an id that comes more than once every vector is asked for every row
        turned = turned.select("query_id", "kb_id").join(turned.select("query_id", "cell", "given"), "query_id")
    parts = max(-(-number // QUERY_GROUP), min(-(-number // LEAST_GROUP), 2 * spark.sparkContext.defaultParallelism), 1)
    order, most = ["kb_id", "cell", F.xxhash64("query_id")], QUERY_GROUP
    ranged = turned.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for table in runs(batches, "kb_id", most):
            ids = table.column("query_id").combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([table.column("kb_id")[0].as_py()], pa.string()), ids, pa.array([b"".join(table.column("given").to_pylist())], pa.binary())], ["pack", "kb_id", "query_ids", "given"])
            number += 1

    return written(ranged.mapInArrow(pack, f"pack long, kb_id string, query_ids array<{kind}>, given binary"), "query-packs").repartition(parts)


def _searched(queries: DataFrame, index: VectorIndex, k: int, report: bool = False) -> DataFrame:
    """Each pack's best ``k`` of the shelves that its task went through; for a report, with how many vectors each query was compared."""
    packs = _packs(queries, index)
    shelves = index.shelves.coalesce(max(1, -(-index.number // SHELVES_PER_TASK)))
    met = packs.hint("shuffle_replicate_nl").join(shelves, "kb_id")
    dim, centres, prunes, held, asked = index.dim, index.centres, index.most_blocks > PRUNE_FROM, index.precision, _precision(queries)
    kind = packs.schema["query_ids"].dataType.elementType.simpleString()

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = None
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("pack")[i].as_py()
                if pack is None or pack.number != number:
                    if pack is not None:
                        yield pack.counts() if report else pack.hits()
                    pack = _Pack(number, batch, i, dim, centres, k, asked)
                pack.meet(batch, i, prunes, held)
        if pack is not None:
            yield pack.counts() if report else pack.hits()

    out = f"query_id {kind}, kb_id string, compared long" if report else f"query_id {kind}, chunk_id string, clause_id string, score double"
    return met.select("pack", "kb_id", "query_ids", "given", "cells", "lowest", "highest", "sizes", "chunk_ids", "clause_ids", "data").mapInArrow(search, out)


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_rows(found, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _first(row: np.ndarray, k: int) -> np.ndarray:
    """Which of sorted row numbers are among the first ``k`` of their row."""
    return np.arange(len(row)) - np.searchsorted(row, row) < k


class _Pack:
    """Queries of a pack and the best ``k`` vectors of each in the shelves met so far."""

    def __init__(self, number: int, batch: pa.RecordBatch, i: int, dim: int, centres: np.ndarray, k: int, precision: str):
        self.number, self.k, self.dim = number, k, dim
        self.kb_id, self.query_ids = batch.column("kb_id")[i].as_py(), batch.column("query_ids").slice(i, 1).flatten()
        # copies: the batch that brought the pack goes
        self.query_ids = pa.concat_arrays([self.query_ids, self.query_ids.slice(0, 0)])
        self.units = unit_rows(np.frombuffer(batch.column("given")[i].as_buffer(), precision).reshape(-1, dim))
        self.angles = angles_to(self.units, centres)
        # products of floats are wrong by this much at most; what they cannot rule out is multiplied as doubles
        self.floats, self.slip = self.units.astype(np.float32), 2.0 * (dim + 8) * 2.0**-24
        self.floor = np.full(len(self.units), -np.inf)
        self.compared = np.zeros(len(self.units), np.int64)
        self.found: pa.Table | None = None

    def meet(self, batch: pa.RecordBatch, i: int, prunes: bool, precision: str) -> None:
        """Take in one shelf."""
        cells, lowest, highest, sizes = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("cells", "lowest", "highest", "sizes"))
        ids, clauses = (batch.column(c).slice(i, 1).flatten() for c in ("chunk_ids", "clause_ids"))
        data = unit_rows(np.frombuffer(batch.column("data")[i].as_buffer(), precision).reshape(-1, self.dim))
        floats = data.astype(np.float32)
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        bounds = None
        if prunes:
            angle = self.angles[:, cells]
            gap = np.maximum(0.0, np.maximum(angle - highest, lowest - angle))
            bounds = np.where(cells == NO_CELL, 1.0, (1.0 + np.cos(gap)) / 2.0)
        starts = np.cumsum(sizes) - sizes
        order = range(len(cells)) if bounds is None else np.argsort(-bounds.mean(axis=0), kind="stable")
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in order:
            need = np.arange(len(self.units)) if bounds is None else np.flatnonzero(bounds[:, b] + SLACK >= self.floor)
            if len(need):
                self.compared[need] += sizes[b]
                own = slice(starts[b], starts[b] + sizes[b])
                held = self._compare(held, need, data[own], floats[own], starts[b], place)
        row, at, score = held
        fresh = pa.table([pa.array(row), pa.array(score), ids.take(pa.array(at)), clauses.take(pa.array(at))], ["row", "score", "chunk_id", "clause_id"])
        if self.found is not None:
            fresh = pa.concat_tables([self.found, fresh]).sort_by([("row", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
            fresh = fresh.filter(pa.array(_first(fresh.column("row").to_numpy(), self.k)))
        self.found = fresh.combine_chunks()
        self._raise(self.found.column("row").to_numpy(), self.found.column("score").to_numpy())

    def _compare(self, held: tuple, need: np.ndarray, data: np.ndarray, floats: np.ndarray, start: int, place: np.ndarray) -> tuple:
        """The best of what is held and one block."""
        raw = self.floats[need] @ floats.T
        least, k = self.floor[need], self.k
        if raw.shape[1] > k and np.isneginf(least).any():
            own = np.partition(raw, raw.shape[1] - k, axis=1)[:, raw.shape[1] - k].astype(np.float64)
            least = np.maximum(least, np.round((1.0 + own - self.slip) / 2.0, PLACES))
        # rounding moves a score by half a place at most
        floor = np.maximum(2.0 * (least - 10.0**-PLACES) - 1.0 - self.slip, -4.0).astype(np.float32)
        row, at = np.divmod(np.flatnonzero(raw >= np.nextafter(floor, np.float32(-5.0))[:, None]), raw.shape[1])
        near = np.concatenate([np.einsum("ij,ij->i", self.units[need[row[i : i + AT_ONCE]]], data[at[i : i + AT_ONCE]]) for i in range(0, max(1, len(row)), AT_ONCE)])
        score = np.round((1.0 + near) / 2.0, PLACES)
        kept = score >= least[row]
        if not kept.any():
            return held
        row, at, score = (np.concatenate(pair) for pair in zip(held, (need[row[kept]], at[kept] + start, score[kept]), strict=True))
        order = np.lexsort((place[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        kept = _first(row, k)
        row, at, score = row[kept], at[kept], score[kept]
        self._raise(row, score)
        return row, at, score

    def _raise(self, row: np.ndarray, score: np.ndarray) -> None:
        """The k-th score of the queries that have ``k`` is what a vector has to reach."""
        last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1)
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])

    def hits(self) -> pa.RecordBatch:
        row, score, ids, clauses = (self.found.column(c).combine_chunks() for c in ("row", "score", "chunk_id", "clause_id"))
        return pa.RecordBatch.from_arrays([self.query_ids.take(row), ids, clauses, score], ["query_id", "chunk_id", "clause_id", "score"])

    def counts(self) -> pa.RecordBatch:
        kb = pa.array([self.kb_id] * len(self.compared), pa.string())
        return pa.RecordBatch.from_arrays([self.query_ids, kb, pa.array(self.compared)], ["query_id", "kb_id", "compared"])
