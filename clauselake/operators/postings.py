"""Lexical retrieval over a written index of postings.

The index has one row for a term and a block of chunks: the gaps between the chunks' slots, their counts, and what bounds
the term's share of any score there (its highest count and the shortest chunk). Gaps and counts are small numbers that lie
byte by byte, all lowest bytes first, so that what is written, shuffled and copied shrinks to little. Blocks are hash buckets of a knowledge base. Rows lie in
partitions by the hash of their term, so a search reads the partitions of its terms alone; the head of a block - ids,
clause ids and lengths of its chunks - lies in a partition of its own.

A search joins query terms and postings by term, and scores every (block, group of queries) in one task. Where a
knowledge base has many blocks, each query's best two blocks by their bounds are scored first; blocks whose bound is below
the k-th score found there are skipped. The result is exact either way, and of the queries only counts and partition
numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.functions.text import joined_tokens, word_tokens
from clauselake.operators.clauses import resolve_clause_id
from clauselake.operators.ordered import top_rows
from clauselake.runtime import scratch_path, ship_by_value, written
from clauselake.sources.buckets import bucket_of

ship_by_value(__name__)

#: bytes of text of a block about, which bound its postings, and chunks at most
BLOCK_BYTES, BLOCK_CHUNKS = 8 << 20, 262_144
#: queries that are scored beside one copy of a block's postings: at least, unless there are fewer, and at most; (block,
#: group) pairs up to which groups are made smaller, so that all cores have work; rows that are unpacked at once
QUERY_GROUP, MOST_GROUP, WORK_PAIRS, ROWS_AT_ONCE = 512, 32_768, 64, 256
#: blocks of a knowledge base beyond which blocks are skipped by their bounds, and blocks that are scored first
PRUNE_FROM, SEED_BLOCKS = 8, 2
#: a term that at least one chunk in so many holds is kept for all slots of a block; adding those up is a pass without lookups
DENSE = 6
#: slots whose highest score is looked at first
STRETCH = 64
#: partitions by term, and chunks for each further one
LEAST_PARTS, MOST_PARTS, CHUNKS_PER_PART = 16, 1024, 50_000
#: the partition of the blocks' heads
HEADS = -1
#: rows of a task's result that leave together
OUT_ROWS = 20_000
#: scores are rounded to so many places, and bounds may be short by their rounding
PLACES, SLACK = 6, 2e-6

POSTINGS = (
    "kb_id string, bucket int, term string, df long, total long, most int, least int, gaps binary, counts binary, "
    "chunk_ids array<string>, clause_ids array<string>, lengths array<int>"
)
KEYS = ["kb_id", "bucket"]


@dataclass(frozen=True)
class PostingsIndex:
    """A readable index: ``rows`` (POSTINGS and ``part``), document frequencies, and the statistics of all chunks."""

    rows: DataFrame
    freq: DataFrame  # term, df
    parts: int
    chunks: int
    avg_dl: float
    most_blocks: int


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of 32-bit values as binary cells; a cell has the lowest bytes of its values, then the next higher ones."""
    size = np.diff(ends)
    at = np.arange(len(values), dtype=np.int32) + np.repeat(3 * ends[:-1].astype(np.int32), size)
    size = np.repeat(size.astype(np.int32), size)
    own, raw = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4), np.empty(4 * len(values), np.uint8)
    for i in range(4):
        raw[at] = own[:, i]
        at += size
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype("<i4").tobytes()), pa.py_buffer(raw)])


def _values(cell: bytes) -> np.ndarray:
    """The values of a binary cell."""
    return np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _invert(table: pa.Table) -> pa.Table:
    """Postings and head of one block of chunks that have tokens."""
    # a block's tokens are most of what a task holds: nothing of their size is kept longer than needed or wider than it must be
    table = table.take(pc.sort_indices(table.column("chunk_id")))
    lists = pc.split_pattern(table.column("tokens"), " ")
    table, n = table.drop_columns(["tokens"]), len(lists)
    lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
    coded = pa.chunked_array([c.flatten() for c in lists.chunks]).combine_chunks().dictionary_encode()
    del lists
    terms, pair = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    del coded
    pair *= n
    pair += np.repeat(np.arange(n, dtype=np.int32), lengths)
    pair.sort()
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    counts = np.diff(np.append(first, len(pair))).astype(np.int32)
    pair = pair[first]
    code, slots = (pair // n).astype(np.int32), (pair % n).astype(np.int32)
    del first, pair
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    ends = np.append(starts, len(code))
    gaps, k = np.diff(slots, prepend=0), len(starts)
    gaps[starts] = slots[starts]
    kb, bucket = table.column("kb_id")[0], table.column("bucket")[0]
    same = lambda v, kind, m: pa.array([v.as_py()] * m, kind)
    none = lambda kind, m: pa.nulls(m, kind)
    strings, numbers = pa.list_(pa.string()), pa.list_(pa.int32())
    rows = [
        same(kb, pa.string(), k), same(bucket, pa.int32(), k), terms.take(pa.array(code[starts])).cast(pa.string()),
        pa.array(np.diff(ends)), none(pa.int64(), k), pa.array(np.maximum.reduceat(counts, starts), pa.int32()),
        pa.array(np.minimum.reduceat(lengths[slots], starts), pa.int32()), _binary(gaps, ends), _binary(counts, ends),
        none(strings, k), none(strings, k), none(numbers, k),
    ]
    ids = [pa.array([table.column(c).to_pylist()], strings) for c in ("chunk_id", "clause_id")]
    head = [
        same(kb, pa.string(), 1), same(bucket, pa.int32(), 1), none(pa.string(), 1), pa.array([n]), pa.array([int(lengths.sum())]),
        none(pa.int32(), 1), none(pa.int32(), 1), none(pa.binary(), 1), none(pa.binary(), 1), *ids, pa.array([lengths.tolist()], numbers),
    ]
    names = [f.strip().split(" ")[0] for f in POSTINGS.split(", ")]
    return pa.concat_tables([pa.Table.from_arrays(rows, names), pa.Table.from_arrays(head, names)])


def block_postings(chunks: DataFrame, parts: int) -> DataFrame:
    """Index rows with their ``part`` for chunks (``chunk_id, kb_id, canonical_id, content``) with a ``bucket``.

    Tokens travel to their blocks as one text a chunk: as an array each would take 16 bytes and more.
    """
    tokens = chunks.select(
        F.col("chunk_id").cast("string"), F.col("kb_id").cast("string"), "bucket", clause_of(chunks).alias("clause_id"),
        joined_tokens(F.col("content")).alias("tokens"),
    )
    rows = tokens.groupBy(*KEYS).applyInArrow(_of_block, POSTINGS)
    return rows.withColumn("part", F.when(F.col("term").isNull(), HEADS).otherwise(part_of(F.col("term"), parts)))


def _of_block(table: pa.Table) -> pa.Table:
    # filtered here: a filter in the plan would have the tokens cut a second time in the scan
    table = table.filter(pc.not_equal(table.column("tokens"), ""))
    return _invert(table) if table.num_rows else _nothing()


def _nothing() -> pa.Table:
    strings, numbers = pa.list_(pa.string()), pa.list_(pa.int32())
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), strings, strings, numbers]
    return pa.Table.from_arrays([pa.nulls(0, k) for k in kinds], [f.strip().split(" ")[0] for f in POSTINGS.split(", ")])


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def clause_of(chunks: DataFrame) -> Column:
    """The canonical id of a chunk, or its own id."""
    canonical = F.col("canonical_id") if "canonical_id" in chunks.columns else F.lit(None)
    return resolve_clause_id(canonical.cast("string"), F.col("chunk_id").cast("string"))


def write_postings(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.repartition("part").sortWithinPartitions("part", "term").write.mode(mode).partitionBy("part").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{POSTINGS}, part int").parquet(path)


def term_frequencies(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("part") != HEADS).groupBy("term").agg(F.sum("df").alias("df"))


def open_index(rows: DataFrame, freq: DataFrame, parts: int) -> PostingsIndex:
    """An index over written ``rows`` and ``freq``; one pass over the heads gives the statistics."""
    heads = rows.filter(F.col("part") == HEADS)
    per_kb = heads.groupBy("kb_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("df").alias("n"), F.sum("total").alias("words"))
    blocks, n, words = per_kb.agg(F.max("blocks"), F.sum("n"), F.sum("words")).first()
    return PostingsIndex(rows, freq, parts, n or 0, (words / n) if n else 1.0, blocks or 0)


def postings_index(chunks: DataFrame, path: str | None = None) -> PostingsIndex:
    """Index ``chunks`` once; the searches read the index and never the texts."""
    spark = chunks.sparkSession
    path = path or scratch_path(spark, "postings")
    total, size = chunks.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("content").cast("string")))).first()
    parts = min(MOST_PARTS, max(LEAST_PARTS, total // CHUNKS_PER_PART))
    buckets = max(1, -(-total // BLOCK_CHUNKS), -(-(size or 0) // BLOCK_BYTES))
    write_postings(block_postings(chunks.withColumn("bucket", bucket_of(F.col("chunk_id"), buckets)), parts), path)
    rows = read_postings(spark, path)
    return open_index(rows, written(term_frequencies(rows), "doc-freq"), parts)


# ---- search ----------------------------------------------------------------
def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, kb_id, term, weight`` with the count of each term in its query."""
    return (
        queries.select("query_id", F.col("kb_id").cast("string").alias("kb_id"), F.explode_outer(word_tokens(F.col("text"))).alias("term"))
        .filter("term IS NOT NULL")
        .groupBy("query_id", "kb_id", "term")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def query_groups(number: int, blocks: int) -> int:
    """Groups of queries: each has a copy of the postings it asks for, so their number grows with the queries only where a
    group would get too large for a task."""
    wanted = -(-WORK_PAIRS // max(1, blocks))
    return max(1, -(-number // MOST_GROUP), min(-(-number // QUERY_GROUP), wanted))


def bm25_hits(queries: DataFrame, index: PostingsIndex, k: int, k1: float = lx.BM25_K1, b: float = lx.BM25_B) -> DataFrame:
    """Best ``k`` chunks per query: ``query_id, chunk_id, clause_id, score, rank``.

    Statistics cover the whole chunk table, the ``kb_id`` filter applies to the hits.
    """
    idf = F.log(1.0 + (F.lit(float(index.chunks)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = query_terms(queries).join(index.freq, "term").select(
        "query_id", "kb_id", "term", (idf * F.col("weight")).alias("boost"), part_of(F.col("term"), index.parts).alias("part")
    )
    wanted = written(wanted, "query-terms")
    number, used = wanted.agg(F.approx_count_distinct("query_id"), F.collect_set("part")).first()
    groups = query_groups(number, index.most_blocks)
    wanted = wanted.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).drop("part")
    rows = index.rows.filter(F.col("part").isin(used))
    heads = index.rows.filter(F.col("part") == HEADS)
    packed = wanted.groupBy("query_id", "kb_id", "g").agg(F.collect_list(F.struct("term", "boost")).alias("terms"))
    scored = lambda pairs, only: _scores(pairs, wanted, rows, heads, index.avg_dl, k, k1, b, only)
    if index.most_blocks <= PRUNE_FROM:
        found = scored(packed.join(heads.select(*KEYS), "kb_id"), False)
    else:
        reach = F.col("boost") * F.col("most") / (F.col("most") + k1 * (1.0 - b + b * F.col("least") / index.avg_dl))
        bounds = rows.select(*KEYS, "term", "most", "least").join(wanted, ["kb_id", "term"]).groupBy("query_id", *KEYS, "g").agg(F.sum(reach).alias("bound"))
        bounds = written(bounds, "bounds")
        seeds = top_rows(bounds, ["query_id"], [F.desc("bound"), F.asc("bucket")], SEED_BLOCKS).select("query_id", *KEYS, "g")
        seeds = written(seeds, "seed-blocks")
        first = written(_best(scored(seeds.join(packed, ["query_id", "kb_id", "g"]), True), k), "first-hits")
        floor = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        rest = bounds.join(seeds, ["query_id", *KEYS, "g"], "left_anti").join(floor, "query_id", "left")
        rest = rest.filter(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
        rest = written(rest.select("query_id", *KEYS, "g"), "open-blocks")
        found = first.drop("rank").unionByName(scored(rest.join(packed, ["query_id", "kb_id", "g"]), True))
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_rows(found, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _scores(
    pairs: DataFrame, wanted: DataFrame, rows: DataFrame, heads: DataFrame, average: float, k: int, k1: float, b: float, only: bool
) -> DataFrame:
    """Scores of (query, block) ``pairs`` (``query_id, kb_id, bucket, g, terms``): at most ``k`` rows for each.

    Every (block, group of queries) is one run of rows: the block's head, the postings its queries ask for, the queries.
    """
    place = [*KEYS, "g"]
    needed = pairs.select(*place).distinct()
    lists = rows.join(wanted.select("kb_id", "term", "g").distinct(), ["kb_id", "term"])
    lists = lists.join(needed, place, "left_semi") if only else lists
    empty = lambda kind: F.lit(None).cast(kind)
    query_kind, terms_kind = (pairs.schema[c].dataType for c in ("query_id", "terms"))
    stored = ["term", "gaps", "counts", "chunk_ids", "clause_ids", "lengths"]
    asked = pairs.select(*place, F.lit(2).alias("kind"), *[empty(rows.schema[c].dataType).alias(c) for c in stored], "query_id", "terms")
    held = [empty(query_kind).alias("query_id"), empty(terms_kind).alias("terms")]
    tops = heads.join(needed, KEYS).select(*place, F.lit(0).alias("kind"), *stored, *held)
    lists = lists.select(*place, F.lit(1).alias("kind"), *stored, *held)
    # a fixed number: the rows are few bytes and much work, so they are not to be coalesced
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = tops.unionByName(lists).unionByName(asked).repartition(tasks, *place).sortWithinPartitions(*place, "kind")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, out = None, _Out(schema)
        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, ROWS_AT_ONCE) for r in batch.slice(i, ROWS_AT_ONCE).to_pylist()):
                if row["kind"] == 0:
                    block = None  # the block before goes first
                    block = _Block(row, average, k1, b)
                elif row["kind"] == 1:
                    block.add(row)
                else:
                    out.add(row["query_id"], block, *block.best(row["terms"], k))
                    if out.rows >= OUT_ROWS:
                        yield out.batch()
        if out.rows:
            yield out.batch()

    kind = query_kind.simpleString()
    schema = pa.schema([("query_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("chunk_id", pa.string()), ("clause_id", pa.string()), ("score", pa.float64())])
    return runs.mapInArrow(score, f"query_id {kind}, chunk_id string, clause_id string, score double")


class _Block:
    """One block and the postings asked for, with each posting's saturated share; of a term that many chunks hold, the
    share of every chunk."""

    def __init__(self, head: dict, average: float, k1: float, b: float):
        self.chunk_ids, self.clause_ids = head["chunk_ids"], head["clause_ids"]
        self.norm = k1 * (1.0 - b + b * np.array(head["lengths"], np.float64) / average)
        self.terms: dict[str, tuple[np.ndarray | None, np.ndarray]] = {}
        self.room = np.empty(len(self.norm))

    def add(self, row: dict) -> None:
        slots, tf = np.cumsum(_values(row["gaps"]), dtype=np.int64), _values(row["counts"])
        share = tf / (tf + self.norm[slots])
        if DENSE * len(slots) < len(self.norm):
            self.terms[row["term"]] = slots.astype(np.int32), share
        else:
            every = np.zeros(len(self.norm))
            every[slots] = share
            self.terms[row["term"]] = None, every

    def best(self, terms: list[dict], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and scores of the query's best chunks; slots ascend with the chunk ids, so ties keep their order."""
        known = [(self.terms[t["term"]], t["boost"]) for t in terms if t["term"] in self.terms]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        raw, sparse = np.zeros(len(self.norm)), [(s, v * boost) for (s, v), boost in known if s is not None]
        if sparse:
            raw = np.bincount(np.concatenate([s for s, _ in sparse]), np.concatenate([v for _, v in sparse]), len(raw))
        for (s, v), boost in known:
            if s is None:
                np.multiply(v, boost, out=self.room)
                raw += self.room
        # k stretches reach the k-th of their maxima, so what rounds to less than that is not looked at
        tops = raw[: len(raw) // STRETCH * STRETCH].reshape(-1, STRETCH).max(axis=1, initial=0.0)
        floor = np.partition(tops, len(tops) - k)[len(tops) - k] if len(tops) > k else 0.0
        hit = np.flatnonzero(raw >= max(floor - SLACK, 10.0**-PLACES / 4))
        score = np.round(raw[hit], PLACES)
        if len(hit) <= k:
            some = score > 0
            hit, score = hit[some], score[some]
            order = np.argsort(-score, kind="stable")
            return hit[order], score[order]
        top = score.max()
        ties = np.flatnonzero(score == top)
        if len(ties) >= k and top > 0:  # chunks with one text have one score
            return hit[ties[:k]], score[ties[:k]]
        least = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > max(least, 0.0))
        above = above[np.argsort(-score[above], kind="stable")]
        order = np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]]) if least > 0 else above
        return hit[order], score[order]


class _Out:
    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, 0
        self.held: list[list] = [[], [], [], []]

    def add(self, query, block: _Block, slots: np.ndarray, scores: np.ndarray) -> None:
        queries, chunks, clauses, values = self.held
        queries.extend([query] * len(slots))
        chunks.extend(block.chunk_ids[s] for s in slots.tolist())
        clauses.extend(block.clause_ids[s] for s in slots.tolist())
        values.extend(scores.tolist())
        self.rows += len(slots)

    def batch(self) -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(h, f.type) for h, f in zip(self.held, self.schema, strict=True)], schema=self.schema)
        self.rows, self.held = 0, [[], [], [], []]
        return done
