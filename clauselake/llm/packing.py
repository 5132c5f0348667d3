"""Packing documents into sequences of a fixed window with solved length combinations.

A document's ids are cut into full windows and one remainder. Few lengths together fill a window (a combination);
non-negative least squares finds how often to use each combination so that the lengths used match the histogram of
remainders. The counts are rounded to what is there, remainders take the places of their length in rank order, and
what is left over is packed greedily: laid end to end and cut at the window.

The histogram has at most ``window`` entries whatever the input, so the solver's work does not grow with it. Ranks and
running totals are made inside the partitions of the staged pieces, with one total for each partition carried over.

Cases: a null text is empty (one end id); a null doc_id is kept; repeated rows are documents of their own; an empty
table gives no pieces; further columns are ignored. Sequences are full but for one at most, which a trainer pads.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clauselake.llm import tokens
from clauselake.llm.common import arrow_map, staged, text_of

WINDOW = 1024
#: rounds of the solver
ROUNDS = 400
#: pieces of one Arrow batch
ROWS = 4000
_PIECES = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("tail", T.BinaryType()),
    ]
)


def combinations(window: int) -> np.ndarray:
    """Shallow combinations that fill the window: (a, b, 0) and (a, b, c), with a on a coarse grid for three lengths."""
    pairs = [(a, window - a, 0) for a in range(1, window // 2 + 1)]
    step = max(1, window // 32)
    triples = [
        (a, b, window - a - b)
        for a in range(step, window, step)
        for b in range(1, (window - a) // 2 + 1)
    ]
    return np.array([*pairs, *triples], np.int64)


def solve(histogram: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and whole repeat counts whose lengths the histogram (entry = length) holds.

    Minimises the squared difference between used and present lengths over non-negative counts by accelerated
    projected gradients, then rounds: whole parts first, then one more by falling fraction, as far as pieces last.
    """
    combos = combinations(window)
    columns = [combos[:, k] for k in range(3)]
    scale = max(1.0, float(histogram.max(initial=0)))
    target = histogram / scale
    target[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(c, x, window + 1) for c in columns)
        total[0] = 0
        return total

    def pull(r: np.ndarray) -> np.ndarray:
        return sum(r[c] for c in columns)

    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = pull(used(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - pull(used(y) - target) / (1.02 * bound))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = nxt + (before - 1) / t * (nxt - x), nxt
    exact = x * scale
    counts = np.zeros(len(combos), np.int64)
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    for more in (np.floor(exact).astype(np.int64), (exact > np.floor(exact)).astype(np.int64)):
        for j in np.argsort(counts - exact, kind="stable"):
            lengths, need = np.unique(combos[j][combos[j] > 0], return_counts=True)
            n = min(int(more[j]), *(int(left[a]) // int(k) for a, k in zip(lengths, need, strict=True)))
            if n:
                counts[j] += n
                left[lengths] -= n * need
    kept = counts > 0
    return combos[kept], counts[kept]


def cut(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents: full windows and remainders; only a remainder carries its ids."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row = tokens.Encoder.load(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.documents_ids(encoder, batch.column("text")), strict=True):
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    out.append((part, row, doc_id, start, len(piece), tokens.crc(piece), len(ids), None if len(piece) == window else piece.tobytes()))
                    row += 1
                if len(out) >= ROWS:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], _PIECES.names)

    return arrow_map(docs, pieces, _PIECES)


def _before(rows: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows, by part and row, within the ``by`` columns.

    Windows are no larger than what one task wrote; across the parts only their totals are summed up.
    """
    inside = Window.partitionBy("part", *by).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*by) if by else Window.partitionBy()
    parts = rows.groupBy("part", *by).agg(F.sum(value).alias("_sum"))
    parts = parts.withColumn("_part", F.coalesce(F.sum("_sum").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(parts.drop("_sum"), ["part", *by]).withColumn(out, F.col("_part") + F.col("_in")).drop("_part", "_in")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = staged(cut(docs, window, vocabulary), "pieces").withColumn("one", F.lit(1).cast("long"))
    counted = pieces.groupBy("length").agg(F.sum("one").alias("n")).collect()  # at most ``window`` rows
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counted:
        histogram[length] = n
    full = int(histogram[window])
    histogram[window] = 0
    combos, repeats = solve(histogram, window)

    # places: ranks first..last of a length go to the sequences from ``sequence`` on, at one offset
    places, taken, sequence = [], np.zeros(window + 1, np.int64), 0
    for lengths, n in zip(combos.tolist(), repeats.tolist(), strict=True):
        offset = 0
        for a in lengths:
            if a:
                places.append((a, int(taken[a]), int(taken[a]) + n - 1, sequence, offset))
                taken[a] += n
                offset += a
        sequence += n
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    windows = _before(pieces.filter(F.col("length") == window).drop("tail"), "one", [], "rank")
    windows = windows.withColumn("sequence_id", F.lit(sequence).cast("long") + F.col("rank")).withColumn("offset", F.lit(0).cast("long"))

    tails = pieces.filter(F.col("length") < window)
    ranked = _before(tails.drop("tail"), "one", ["length"], "rank")
    grid = spark.createDataFrame(places, "length long, first long, last long, sequence long, offset long")
    # the grid has no more than three rows for each combination, whatever the input
    placed = ranked.join(F.broadcast(grid), "length").filter(F.col("rank").between(F.col("first"), F.col("last")))
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first"))

    used = spark.createDataFrame([(a, int(n)) for a, n in enumerate(taken) if n], "length long, used long")
    rest = ranked.join(F.broadcast(used), "length", "left").filter(F.col("rank") >= F.coalesce("used", F.lit(0)))
    rest = rest.select("part", "row").join(tails, ["part", "row"])
    laid = _before(rest, "length", [], "laid").drop("one")
    types = T.StructType([f for f in _PIECES if f.name not in ("part", "row", "tail")] + [T.StructField("laid", T.LongType())])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids, at = np.frombuffer(r["tail"], "<u4"), 0
                while at < len(ids):
                    n = min(len(ids) - at, window - (r["laid"] + at) % window)
                    out.append((r["doc_id"], r["start"] + at, n, tokens.crc(ids[at : at + n]), r["doc_tokens"], r["laid"] + at))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(6)], types.names)

    split_rows = laid.mapInArrow(split, types)
    split_rows = split_rows.withColumn("sequence_id", F.lit(sequence + full).cast("long") + F.floor(F.col("laid") / window))
    split_rows = split_rows.withColumn("offset", F.col("laid") % window)
    return windows.select(*kept).unionByName(placed.select(*kept)).unionByName(split_rows.select(*kept))
