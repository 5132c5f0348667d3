"""Ranked lexical search over bit-sliced Bloom signatures.

The index is a table of blocks of documents with about as many terms each. A block holds its signature - one bitmap of
its documents for each bit of a Bloom filter (a slice) - and, for the exact scores, every document's term hashes and
counts. A term that occurs tf times is entered once for each power of two up to tf, so the slices of (term, level) meet
in a bitmap of the documents that may hold the term at least 2 ** level times: never too few, now and then too many.

A search meets a block with all its items at once. The levels found bound each term's count from above, weighted sums
of the bounds over an item's terms bound its score for every document of the block, and only documents whose bound
reaches the item's fiftieth score so far are scored exactly, from their own counts. A task keeps the best of each item
over all its blocks. A first search over a sixteenth of the blocks finds a lower bound of every fiftieth score, so tasks
return little more than the result; it changes no result.

Score: with N documents that hold a term, L terms in all, n terms in the document (m = 50 + (50 n N) div L) and df
documents with the term, the sum over the item's distinct terms of w ((10**9 tf) div (1000 tf + 20 m)),
w = floor(1000 ln((2 N + 2) / (2 df + 1))). Equal scores are ordered by doc_id, null last. Terms are told apart by
64-bit hashes of their bytes.

Items are answered in sets of a bounded number of terms; each set is one scan of the index, never of the texts.

Cases: a null or empty text holds no term, is no hit and has no hits; a null doc_id is returned as null; repeated
documents are documents of their own; rows of the benchmark that repeat id and text are one item, rows of one id with
different texts are answered apart; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import arrow_map, bounded, mix, ragged, release, staged, word_table

TOP = 50
#: Bloom filter: bits for each entry at least, hash functions, and bits at most (a longer document is scored more often)
ENTRY_BITS, HASHES, MOST_BITS = 8, 3, 1 << 20
#: documents and terms after which a block is closed
BLOCK_DOCS, BLOCK_TERMS = 2048, 1 << 18
#: terms of the items that are answered in one scan of the index
SET_TERMS = 50_000
#: bounds held at once, as terms x documents
BOUNDS_AT_ONCE = 2_000_000
#: the part of the blocks that the first search reads
SAMPLE = 16
#: terms are runs of letters and digits of ASCII and of all bytes beyond
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_INDEX = "block long, width int, doc_ids array<long>, n array<long>, ends array<int>, hashes binary, counts binary, slices binary"


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct term hashes of each text in ascending order, their counts, the ends of the texts, and all terms per text."""
    words, _, first = word_table(texts, GAP)
    total = np.diff(first)
    doc = np.repeat(np.arange(len(total)), total)
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(at, append=len(words))
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(total)))])
    return words[at], counts, ends, total


def entry_places(hashes: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """The slices (HASHES x entries) of (term, level)."""
    key = mix(hashes + (np.atleast_1d(level).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    step = (key >> np.uint64(32)) | np.uint64(1)
    return np.stack([((key + np.uint64(k) * step) & np.uint64(width - 1)).astype(np.int64) for k in range(HASHES)])


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Entries of a term with each count: 1 + floor(log2)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def signature(hashes: np.ndarray, counts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """width x bytes: bit d of slice s is set when an entry of document d has the place s."""
    docs = len(ends) - 1
    doc = np.repeat(np.arange(docs), np.diff(ends))
    row = -(-docs // 8)
    bits = np.zeros(width * row * 8, bool)
    each = levels_of(counts)
    level = ragged(np.zeros(len(each), np.int64), each)
    for places in entry_places(np.repeat(hashes, each), level, width):
        bits[places * (row * 8) + np.repeat(doc, each)] = True
    return np.packbits(bits.reshape(width, row * 8), axis=1, bitorder="little")


def width_of(entries: int) -> int:
    """Slices for the documents with so many entries: a power of two."""
    return min(MOST_BITS, max(64, 1 << int(ENTRY_BITS * entries - 1).bit_length()))


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of all documents with a term, written once."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        number = TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in bounded(whole)):
            hashes, counts, ends, total = term_counts(batch.column("text"))
            entries = np.add.reduceat(np.append(levels_of(counts), 0), ends[:-1]) if len(total) else np.zeros(0, np.int64)
            ids = batch.column("doc_id").to_pylist()
            for d in np.flatnonzero(total).tolist():
                a, b = ends[d], ends[d + 1]
                width = width_of(int(entries[d]))
                mine = held.setdefault(width, [])
                mine.append((ids[d], int(total[d]), hashes[a:b].copy(), counts[a:b].astype(np.uint32)))
                if len(mine) >= BLOCK_DOCS or len(mine) * width >= BLOCK_TERMS * ENTRY_BITS:
                    yield block(number, width, held.pop(width))
                    number += 1
        for width in sorted(held):
            yield block(number, width, held[width])
            number += 1
        held.clear()
        release()

    def block(number: int, width: int, docs: list[tuple]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(d[2]) for d in docs])])
        hashes, counts = np.concatenate([d[2] for d in docs]), np.concatenate([d[3] for d in docs])
        slices = signature(hashes, counts.astype(np.int64), ends, width)
        row = [number, width, [d[0] for d in docs], [d[1] for d in docs], ends.tolist(), hashes.tobytes(), counts.tobytes(), slices.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    lists = {"doc_ids": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "ends": pa.list_(pa.int32())}
    plain = {"block": pa.int64(), "width": pa.int32(), "hashes": pa.binary(), "counts": pa.binary(), "slices": pa.binary()}
    schema = pa.schema([(c, (lists | plain)[c]) for c in ("block", "width", "doc_ids", "n", "ends", "hashes", "counts", "slices")])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(arrow_map(rows, blocks, _INDEX), "lexical-index")


@dataclass
class Items:
    """A bounded set of items: their distinct terms, the terms of each item, and the terms' weights."""

    terms: np.ndarray  # ascending hashes
    ends: np.ndarray  # of the items, in ``of``
    of: np.ndarray  # places in ``terms``, item after item
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents that hold each of the terms."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(terms), np.int64)
        for batch in batches:
            for raw in batch.column("hashes"):
                held = np.frombuffer(raw.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(terms, held), len(terms) - 1)
                found += np.bincount(at[terms[at] == held], minlength=len(terms))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "n"])

    counted = arrow_map(index.select("hashes"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(len(terms), np.int64)
    for row in counted.collect():  # one row a term of the set at most
        df[row["term"]] = row["n"]
    return df


def length_norm(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with ``n`` terms, in whole numbers of any size."""
    if 50 * int(n.max(initial=0)) * docs < 1 << 62:
        return 50 + (50 * n * docs) // terms
    return 50 + np.array([(50 * int(x) * docs) // terms for x in n], np.int64)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Block:
    """A row of the index."""

    def __init__(self, row: dict, docs: int, terms: int):
        self.ids = row["doc_ids"]
        self.ends = np.array(row["ends"], np.int64)
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.n = np.array(row["n"], np.int64)
        self.width = row["width"]
        self.slices = np.frombuffer(row["slices"], np.uint8).reshape(self.width, -1)
        self.m = length_norm(self.n, docs, terms)

    def levels(self, terms: np.ndarray) -> np.ndarray:
        """terms x documents: entries of the term that the document may have."""
        found = np.zeros((len(terms), len(self.n)), np.uint8)
        left, level, before = np.arange(len(terms)), 0, None
        while len(left) and level < 64:
            places = entry_places(terms[left], level, self.width)
            bits = self.slices[places[0]]
            for more in places[1:]:
                bits = bits & self.slices[more]
            bits = bits if before is None else bits & before
            some = bits.any(axis=1)
            left, before = left[some], bits[some]
            found[left] += np.unpackbits(before, axis=1, bitorder="little", count=len(self.n))
            level += 1
        return found

    def bounds(self, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of documents: the first, items x documents upper bounds of the scores, and the levels found."""
        levels = self.levels(items.terms)
        top = int(levels.max(initial=0))
        most = np.minimum((1 << np.arange(top + 1)).astype(np.int64)[:, None] - 1, self.n[None, :])
        reach = saturation(most, self.m[None, :])  # by level and document
        step = max(1, BOUNDS_AT_ONCE // max(1, len(items.of)))
        for at in range(0, len(self.n), step):
            part = levels[:, at : at + step]
            columns = np.arange(at, at + part.shape[1])
            value = items.weight[:, None] * reach[part, columns[None, :]]
            yield at, np.add.reduceat(value[items.of], items.ends[:-1], axis=0), levels

    def scores(self, items: Items, item: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Exact scores of pairs: each term is looked up among the document's own, by bisection of all at once."""
        each = items.ends[item + 1] - items.ends[item]
        term = items.of[ragged(items.ends[item], each)]
        d = np.repeat(doc, each)
        low, high = self.ends[d], self.ends[d + 1]
        needle = items.terms[term]
        while True:
            open_ = low < high
            if not open_.any():
                break
            middle = (low + high) >> 1
            less = open_ & (self.hashes[np.minimum(middle, len(self.hashes) - 1)] < needle)
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        at = np.minimum(low, len(self.hashes) - 1)
        tf = np.where((low < self.ends[d + 1]) & (self.hashes[at] == needle), self.counts[at], 0)
        value = items.weight[term] * saturation(tf, self.m[d])
        return np.add.reduceat(value, np.cumsum(each) - each) if len(each) else np.zeros(0, np.int64)


class Best:
    """The best documents of every item so far: score descending, doc_id ascending, null last."""

    def __init__(self, floor: np.ndarray, top: int):
        self.floor, self.top = floor.copy(), top
        self.item, self.score, self.doc, self.null = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = (score >= self.floor[item]) & (score > 0)
        if not good.any():
            return
        item, score = np.concatenate([self.item, item[good]]), np.concatenate([self.score, score[good]])
        doc, null = np.concatenate([self.doc, doc[good]]), np.concatenate([self.null, null[good]])
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[rank < self.top]
        item = item[rank < self.top]
        self.item, self.score, self.doc, self.null = item, score[kept], doc[kept], null[kept]
        full = np.flatnonzero(np.bincount(item, minlength=len(self.floor)) >= self.top)
        last = np.searchsorted(item, full, side="right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last])


def meet(block: Block, items: Items, best: Best) -> int:
    """Score the documents of a block that are not provably beyond an item's best; returns how many pairs."""
    scored = 0
    null = np.array([i is None for i in block.ids], np.int64)
    ids = np.array([0 if i is None else i for i in block.ids], np.int64)

    def score(item: np.ndarray, doc: np.ndarray) -> int:
        per = max(1, BOUNDS_AT_ONCE // max(1, int((items.ends[1:] - items.ends[:-1]).max(initial=1))))
        for k in range(0, len(item), per):
            i, d = item[k : k + per], doc[k : k + per]
            best.add(i, block.scores(items, i, d), ids[d], null[d])
        return len(item)

    for at, bound, _ in block.bounds(items):
        first = np.zeros(bound.shape, bool)
        short = np.flatnonzero(best.floor <= 1)
        if len(short):  # the highest bounds first, so that the floor rises before the rest is looked at
            k = min(best.top, bound.shape[1])
            high = np.argpartition(-bound[short], k - 1, axis=1)[:, :k]
            first[short[:, None], high] = True
            first &= bound >= np.maximum(best.floor, 1)[:, None]
            i, d = np.nonzero(first)
            scored += score(i, d + at)
        i, d = np.nonzero((bound >= np.maximum(best.floor, 1)[:, None]) & ~first)
        scored += score(i, d + at)
    return scored


def search_blocks(index: DataFrame, items: Items, docs: int, terms: int, floor: np.ndarray, top: int) -> DataFrame:
    """Of each task: item, doc_id, score of its best documents, and (item null) the number of pairs it scored exactly."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, scored = Best(floor, top), 0
        for batch in batches:
            for k in range(batch.num_rows):
                scored += meet(Block(batch.slice(k, 1).to_pylist()[0], docs, terms), items, best)
        doc = pa.array(best.doc, mask=best.null.astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(best.item), doc, pa.array(best.score)], ["item", "doc_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([scored])], ["item", "doc_id", "score"])
        release()

    return arrow_map(index.drop("block"), run, "item long, doc_id long, score long").filter("item IS NOT NULL")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def item_sets(items: DataFrame, limit: int) -> list[int]:
    """How many sets hold about ``limit`` terms each (a term is two bytes or more with the gap after it)."""
    size = items.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0
    return list(range(max(1, -(-int(size) // limit))))


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """The best ``top`` documents of every item: item_id, rank, doc_id, score."""
    index = build_index(docs) if index is None else index
    spark = index.sparkSession
    documents, total = index.agg(F.sum(F.size("doc_ids")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    schema = "item_id long, rank int, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    sets = item_sets(items, SET_TERMS)
    for s in sets if documents else []:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(len(sets))) == s).collect()  # bounded by SET_TERMS
        rows = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        hashes, _, ends, _ = term_counts(pa.array([r["text"] for r in rows], pa.string()))
        some = np.flatnonzero(np.diff(ends))
        if not len(some):
            continue
        ids = [rows[k]["item_id"] for k in some.tolist()]
        terms, of = np.unique(hashes, return_inverse=True)
        df = frequencies(index, terms)
        weight = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)
        asked = Items(terms, np.concatenate([[0], ends[some + 1]]), of, np.where(df > 0, weight, 0))
        found = _one_set(index, asked, documents, total, top)
        names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def _one_set(index: DataFrame, asked: Items, documents: int, total: int, top: int) -> DataFrame:
    floor = np.zeros(len(asked), np.int64)
    sample = index.filter(F.pmod(F.xxhash64("block"), F.lit(SAMPLE)) == 0)
    first = ranked(search_blocks(sample, asked, documents, total, floor, top), top).filter(F.col("rank") == top)
    for row in first.select("item", "score").collect():  # one row an item of the set
        floor[row["item"]] = row["score"]
    return ranked(search_blocks(index, asked, documents, total, floor, top), top)


def oracle() -> str:
    """The same rows for ``documents`` and ``benchmark``, by joining every term."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ts FROM documents WHERE text IS NOT NULL),
  d AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM t WHERE len(ts) > 0),
  s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
  tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM t) GROUP BY r, term),
  i AS (SELECT row_number() OVER () AS q, item_id, {words} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
  qt AS (SELECT DISTINCT q, term FROM (SELECT q, unnest(ts) AS term FROM i)),
  w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qt) GROUP BY term), s),
  m AS (SELECT r, doc_id, 50 + (50 * n * nn) // ll AS m FROM d, s),
  h AS (SELECT q, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN m ON m.r = tf.r GROUP BY q, m.r, m.doc_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM h WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= {TOP}"""
