"""Connected components of links, by joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import staged


def local_star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links (a, b) with one link a node: (node, smallest node), without the roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for side in (left, right, label[left], label[right]):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of consecutive equal keys, and the number of each row's group.

    The rows come sorted by the keys; what a batch leaves unfinished waits for the next.
    """

    def borders(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return new

    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = tuple(batch.column(k)[0].as_py() for k in keys)
        tail = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        if ends == tail and (last is None or last == ends):  # still inside one group
            waiting.append(batch)
            last = tail
            continue
        table = pa.Table.from_batches([*waiting, batch])
        new = borders(table)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield table.slice(0, cut), np.cumsum(new[:cut]) - 1
        waiting, last = table.slice(cut).to_batches(), tail
    if waiting:
        table = pa.Table.from_batches(waiting)
        yield table, np.cumsum(borders(table)) - 1


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return row[0], row[1] or 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node, from links (a, b); the component is the smallest node reachable.

    Alternates large and small stars: each node's neighbours are linked to its smallest neighbour, until every link
    leads to a root. A node's links are never gathered: minima are partial aggregates, and links meet them by joins
    that adaptive execution splits when one node is hot. Rounds grow with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = staged(edges, "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        moved = small.filter("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = staged(moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
