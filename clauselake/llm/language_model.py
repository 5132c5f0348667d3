"""Hierarchical Pitman-Yor language model of word pairs, and the log probabilities of all texts.

Every context (the word before, or the start of a text) is a restaurant whose parent is the common root. A restaurant
seats its words' tokens at tables, each table draws from the root, and the root's own base is uniform over the known
words and one unknown class. Seatings are sampled by blocked Gibbs sweeps with a gamma variable x for each restaurant:
given x, its words' tables are independent, ``p(t) ~ (d x root(w))^t S_d(c, t)`` with the generalised Stirling numbers
S_d; given all tables, x is gamma distributed. Beyond ``STIRLING`` customers a word's tables are seated in stretches
instead. Predictive probabilities are averaged over the sampled sweeps before the logarithm. All draws are told by the
numbers of context and word and of the sweep, so a score depends on the training texts alone, neither on
chunks, shards and places nor on the order of rows.

The root's customers are the tables of its children. After each sweep over the restaurants their tables are sent up, in
blocks of word numbers, and added up by word; the root seats them in a sweep of its own, with one gamma variable and the
Stirling numbers of its discount; the customers and tables of each word go back to the shards that hold it, and the next
sweep draws with the root's predictive probabilities of that seating. Before the first sweep the root is seated from all
training tokens, one table a word; ``held`` keeps it so, and no table is sent.

Work is done in chunks of documents, ranges of word hashes, and shards of contexts, each of bounded size. A chunk keeps
its vocabulary and the texts' word numbers, in a table bucketed by chunk that later joins read without a shuffle. Its
words' counts go to the ranges and come back as totals, with the words' ranks among all; the counts of its distinct word pairs go to the
shards, in buckets of the shards that are written once, and one seating a pair comes back, which the chunk makes its texts'
probabilities of. A shard's pairs are added up once, for all sweeps. The words of a restaurant with more than ``WIDE``
customers lie in several shards, whose tables are added up by context after each sweep. What a sweep has written is
deleted when the next one has read it.

Words are compared by 64-bit hashes. Cases: a null text is empty and
has the end token only; a null doc_id is kept and trained on; repeated rows are texts of their own, in training too;
without training texts every token is unknown and the model has only the unknown class (probability 1); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import atexit
import functools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import BASE, arrow_map, bounded, discard, fresh_path, in_fold, mix, release, staged, text_of, word_table

#: bytes of text of a chunk, words (each with its chunk) of a range, tokens of a shard, customers of a restaurant for
#: each place its words lie in; none of them changes a score
CHUNK_BYTES, RANGE_WORDS, SHARD_PAIRS, WIDE = 10 << 20, 1 << 20, 1 << 20, 1 << 18
#: discount and concentration of the restaurants and of the root
DISCOUNT, CONCENTRATION = 0.8, 1.0
ROOT_DISCOUNT, ROOT_CONCENTRATION = 0.6, 1.0
#: sweeps thrown away and sweeps averaged, and customers up to which Stirling numbers are tabled
BURN, SAMPLES, STIRLING = 2, 3, 64
#: the hash of the end token, which no word has but by accident; the context before the first word, others follow it
END, START = np.uint64(0x0F3D9E2B5A7C4811), np.uint64(0)
_CHUNKS = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), *[(c, pa.binary()) for c in ("first", "words", "vocabulary", "counts")]])
_CHUNK_TYPE = "chunk long, size long, doc_ids array<long>, held_out array<boolean>, first binary, words binary, vocabulary binary, counts binary"
#: the root's own key, and what stands in place of a block of words: tables of contexts that lie in several shards, and what
#: a shard keeps for its next sweep
ROOT, CONTEXTS, KEPT = np.uint64(0x5851F42D4C957F2D), -1, -2
_BACK = "chunk long, shard int, customers binary, tables binary, all_tables binary"
_TABLES = "shard int, block int, words binary, customers binary, tables binary, all_tables long"
_PAIRS = pa.schema([("shard", pa.int32()), ("spread", pa.bool_()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("contexts", "runs", "customers", "words", "totals", "places", "counts")]])
_PAIR_TYPE = "shard int, spread boolean, chunk long, contexts binary, runs binary, customers binary, words binary, totals binary, places binary, counts binary"


@functools.cache
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(values: np.ndarray) -> bytes:
    """As few bytes a value as the largest takes (told by the first byte), compressed by byte planes, so that bytes of one
    significance stand together."""
    values = np.ascontiguousarray(values)
    plain = values.view(f"u{values.itemsize}")
    top = int(plain.max(initial=0))
    size = next(k for k in (1, 2, 4, 8) if top < 1 << 8 * k)
    planes = plain.astype(f"u{size}", copy=False).view(np.uint8).reshape(-1, size).T
    return bytes([size]) + _codec()[0].compress(planes.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(_codec()[1].decompress(memoryview(data)[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(data[0], -1).T).view(f"u{data[0]}").ravel().astype(kind)


def _differences(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.zeros(1, np.uint64))


def gathered(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows in batches of about ``limit`` bytes of text, whatever the sizes they come in."""
    held, size = [], 0
    for batch in (part for whole in batches for part in bounded(whole, limit=limit // 8)):
        if held and size + batch.column("text").nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.column("text").nbytes
    if held:
        yield pa.concat_batches(held)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """Texts as numbers in a vocabulary of their chunk (sorted by hash), with the training counts of its words."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, CHUNK_BYTES):
            hashes, _, first = word_table(batch.column("text"))
            n = len(first) - 1
            ends = first[1:] + np.arange(n)  # each text's end token, behind its words
            stream = np.empty(len(hashes) + n, np.uint64)
            stream[ends] = END
            inside = np.ones(len(stream), bool)
            inside[ends] = False
            stream[inside] = hashes
            first = first + np.arange(n + 1)
            vocabulary, words = np.unique(stream, return_inverse=True)
            trained = ~np.repeat(batch.column("held_out").to_numpy(zero_copy_only=False), np.diff(first))
            counts = np.bincount(words[trained], minlength=len(vocabulary))
            row = [number, len(vocabulary), batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), _pack(first.astype(np.int64)), _pack(words.astype(np.uint32)), _pack(_differences(vocabulary)), _pack(counts.astype(np.uint32))]
            yield pa.RecordBatch.from_pylist([dict(zip(_CHUNKS.names, row, strict=True))], schema=_CHUNKS)
            number += 1
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), 5).alias("held_out"), text_of(docs).alias("text"))
    return arrow_map(rows, chunks, _CHUNK_TYPE)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write a stage to the shared folder in buckets of ``key``: joins on it shuffle the other side only."""
    spark = df.sparkSession
    name = f"clauselake_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", fresh_path(spark, "buckets")).format("parquet").saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has already ended, and its catalogue with it
        pass


def word_totals(chunks: DataFrame) -> DataFrame:
    """For each chunk and range of hashes: its words' training tokens in all chunks and their ranks among the range's
    distinct words, in the order of its vocabulary.

    ``tokens``, ``words`` and ``distinct`` hold the range's training tokens, known and distinct words, in one row of each.
    """
    size = chunks.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, -(-size // RANGE_WORDS))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = np.cumsum(_unpack(row["vocabulary"], np.uint64), dtype=np.uint64), _unpack(row["counts"], np.uint32)
                of = ((words >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(of, np.arange(ranges + 1)).tolist()
                parts = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                columns = [pa.array([k for k, _, _ in parts], pa.int32()), pa.array([row["chunk"]] * len(parts), pa.int64()), pa.array([_pack(_differences(words[a:b])) for _, a, b in parts], pa.binary()), pa.array([_pack(counts[a:b]) for _, a, b in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["range", "chunk", "words", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        words = [np.cumsum(_unpack(w, np.uint64), dtype=np.uint64) for w in rows["words"]]
        counts = np.concatenate([_unpack(c, np.uint32) for c in rows["counts"]])
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, counts, len(distinct)).astype(np.int64)
        ranks = np.split(at.astype(np.uint64), np.cumsum([len(w) for w in words])[:-1])
        out = pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "range": rows["range"].to_numpy(), "n": [_pack(total[r]) for r in ranks], "ranks": [_pack(_differences(r)) for r in ranks], "tokens": 0, "words": 0, "distinct": 0})
        out.loc[out.index[0], ["tokens", "words", "distinct"]] = [int(total.sum()), int((total > 0).sum()), len(distinct)]
        release()
        return out

    sent = chunks.select("chunk", "vocabulary", "counts").mapInArrow(send, "range int, chunk long, words binary, counts binary")
    return staged(sent.groupBy("range").applyInPandas(add, "chunk long, range int, n binary, ranks binary, tokens long, words long, distinct long"), "word-totals")


def root_probability(n: np.ndarray, tokens: float, words: float, tables: np.ndarray | float = 1.0, all_tables: float | None = None) -> np.ndarray:
    """The root's probability of words with ``n`` of its ``tokens`` customers at ``tables`` of its ``all_tables`` tables;
    0 customers: the unknown class.

    Without tables: one a word. The base gives one half to the unknown class and shares the other among the known words.
    """
    if not words:
        return np.ones(len(n))
    mass = (ROOT_CONCENTRATION + ROOT_DISCOUNT * (words if all_tables is None else all_tables)) / (ROOT_CONCENTRATION + tokens)
    return np.where(n > 0, (n - ROOT_DISCOUNT * tables) / (ROOT_CONCENTRATION + tokens) + mass * 0.5 / words, mass * 0.5)


def stirling_table(discount: float, top: int = STIRLING) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(c, t) for 0 <= t <= c <= top."""
    table = np.full((top + 1, top + 1), -np.inf)
    table[0, 0] = 0.0
    for c in range(1, top + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            stay = table[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - discount * t, 1e-300))
        table[c, 1 : c + 1] = np.logaddexp(table[c - 1, :c], stay)
    return table


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """Uniform numbers in (0, 1) told by ``keys`` and the number of the draw alone, wherever they are drawn."""
    spread = mix(keys ^ mix(np.full(1, draw + 1, np.uint64)))
    return ((spread >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def gamma(shape: np.ndarray, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Gamma variates (shape above 1) by rejection from the cube of a normal one."""
    out, left, k = np.empty(len(shape)), np.arange(len(shape)), 0
    while len(left):
        a, key = shape[left] - 1 / 3, keys[left]
        u, v, w = (uniform(key, (sweep << 20) + 3 * k + j) for j in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        cube = np.maximum(1 + x / np.sqrt(9 * a), 1e-9) ** 3
        good = (np.log(w) < x * x / 2 + a - a * cube + a * np.log(cube)) & (cube > 1e-26)
        out[left[good]] = (a * cube)[good]
        left, k = left[~good], k + 1
    return out


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, draws) -> np.ndarray:
    """Tables of words seated in stretches of customers; ``weight`` is that of a new table.

    A stretch is one customer up to the 16th and a sixteenth of those seated from there on; ``draws(at, n)`` are the
    uniform numbers that round its expected new tables.
    """
    tables = (customers > 0).astype(np.int64)
    order = np.argsort(-customers, kind="stable")
    sizes, n = -customers[order], 1
    while n < int(customers.max(initial=0)):
        at = order[: np.searchsorted(sizes, -n, side="left")]  # words with more than n customers
        stretch = np.minimum(max(1, n // 16), customers[at] - n)
        new = stretch * weight[at] / (weight[at] + n - discount * tables[at])
        tables[at] += np.floor(new + draws(at, n)).astype(np.int64)
        n += max(1, n // 16)
    return tables


def draw_tables(c: np.ndarray, weight: np.ndarray, keys: np.ndarray, sweep: int, stirling: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """Tables of words with ``c`` customers, each from its conditional ``p(t) ~ weight^t S_d(c, t)``."""
    t = (c > 0).astype(np.int64)
    many = np.flatnonzero((c > 1) & (c <= STIRLING))
    chance = uniform(keys[many], sweep)
    for size in np.unique(c[many]).tolist():
        of = np.flatnonzero(c[many] == size)
        at, k = many[of], np.arange(1, size + 1)
        log = np.log(weight[at])[:, None] * k + stirling[size, 1 : size + 1][None, :]
        p = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
        t[at] = 1 + (p < (chance[of] * p[:, -1])[:, None]).sum(axis=1)
    large = np.flatnonzero(c > STIRLING)
    if len(large):
        t[large] = seat(c[large], weight[large], discount, lambda at, n: uniform(keys[large[at]], (sweep << 40) + n))
    return t


def scale(sweep: int, contexts: np.ndarray, customers: np.ndarray, tables: np.ndarray | None) -> np.ndarray:
    """Each restaurant's gamma variable in a sweep, given its tables after the sweep before (none before the first).

    ``prod_i<T (theta + d i)`` is, but for a constant, ``d^T`` times the integral of ``x^(theta / d + T - 1) exp(-x)``:
    given x, the tables of a restaurant's words are independent of one another.
    """
    shape = CONCENTRATION / DISCOUNT
    return shape + customers**DISCOUNT if tables is None else gamma(shape + tables, contexts, sweep)


def seatings(contexts: np.ndarray, customers: np.ndarray, group: np.ndarray, words: np.ndarray, c: np.ndarray, root: np.ndarray, wide: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each (restaurant, word) and of each restaurant, added up over the sampled sweeps.

    ``c`` are training counts (0: a word only scored), ``contexts`` and ``customers`` have an entry for each restaurant,
    ``group`` is each pair's restaurant. ``wide`` holds, by context, the tables after each sweep of restaurants whose
    words lie in several places.
    """
    stirling = stirling_table(DISCOUNT)
    keys = mix(contexts[group] ^ mix(words))
    spread = [(g, wide[u]) for g, u in enumerate(contexts.tolist()) if u in wide] if wide else []
    tables, sums, all_sums = None, np.zeros(len(c), np.int64), np.zeros(len(contexts), np.int64)
    for sweep in range(BURN + SAMPLES):
        x = scale(sweep, contexts, customers, tables)
        t = draw_tables(c, DISCOUNT * x[group] * root, keys, sweep, stirling)
        tables = np.bincount(group, t, len(contexts)).astype(np.int64)
        for g, known in spread:
            tables[g] = known[sweep]
        if sweep >= BURN:
            sums, all_sums = sums + t, all_sums + tables
    return sums, all_sums


def predictive(c: np.ndarray, sums: np.ndarray, all_sums: np.ndarray, customers: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Probability of each pair, averaged over the sampled sweeps, whose tables it is linear in."""
    return (c - DISCOUNT * sums / SAMPLES + (CONCENTRATION + DISCOUNT * all_sums / SAMPLES) * root) / (CONCENTRATION + customers)


def predictive_by_sweep(c: np.ndarray, sums: np.ndarray, customers: np.ndarray, of_sweeps: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The same where the root moves: ``of_sweeps`` are its probabilities of the words after each sampled sweep, with the
    tables of the restaurants before they were sent up."""
    p = c - DISCOUNT * sums / SAMPLES
    for tables, root in of_sweeps:
        p += (CONCENTRATION + DISCOUNT * tables) * root / SAMPLES
    return p / (CONCENTRATION + customers)


def _totals(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and numbers of a chunk's vocabulary, from the parts that its ranges gave back.

    A word's number is its rank among all distinct words, so that it does not depend on chunks and ranges.
    """
    parts = sorted(row["parts"], key=lambda p: p["range"])
    numbers = [np.cumsum(_unpack(p["ranks"], np.uint64), dtype=np.uint64) + np.uint64(p["offset"]) for p in parts]
    return np.concatenate([_unpack(p["n"], np.int64) for p in parts]), np.concatenate(numbers)


def chunk_pairs(row: dict, shards: int, wide: int, spread: bool | None = None) -> dict[str, np.ndarray]:
    """The tokens of a chunk in the order of their shards, contexts and words, where its distinct pairs begin, and the
    pairs' training counts.

    ``word`` are places in the chunk's vocabulary, whose numbers ascend and whose training tokens are ``n``. A shard has
    two numbers, the higher for its restaurants whose words lie in several places; ``spread``: only their tokens, or only
    those of the others.
    """
    word, first = _unpack(row["words"], np.uint32).astype(np.int64), _unpack(row["first"], np.int64)
    (n, numbers), heads = _totals(row), first[:-1]
    context = np.concatenate([[0], word[:-1] + 1])  # the place of the word before, from 1 on; 0: the start of a text
    context[heads] = 0
    of = np.concatenate([[n[word[first[1] - 1]]], n])  # customers by context; as many texts begin as end
    taken = np.arange(len(word)) if spread is None else np.flatnonzero((of > wide)[context] == spread)
    context, told = context[taken], word[taken]
    names = np.concatenate([[START], numbers + np.uint64(1)])
    name, several = mix(names), of > wide
    shard_at = lambda name: (mix(name) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    shard = (shard_at(name) * np.uint64(2))[context]
    # a restaurant's words lie in as many places as it has ``wide`` customers
    at = np.flatnonzero(several[context])
    u = context[at]
    part = mix(name[u] ^ numbers[told[at]]) % (-(-of // wide)).astype(np.uint64)[u]
    shard[at] = shard_at(name[u] + part * np.uint64(BASE)) * np.uint64(2) + np.uint64(1)
    high, low = (2 * shards - 1).bit_length(), len(n).bit_length()
    new = np.ones(len(told), bool)
    if high + 2 * low <= 64:
        by = shard << np.uint64(2 * low) | context.astype(np.uint64) << np.uint64(low) | told.astype(np.uint64)
        order = np.argsort(by)  # tokens of one pair in any order
        by = by[order]
        new[1:] = by[1:] != by[:-1]
    else:
        order = np.lexsort((told, context, shard))
        new[1:] = (np.diff(told[order]) != 0) | (np.diff(context[order]) != 0) | (np.diff(shard[order]) != 0)
    at = order[new]
    trained = ~np.repeat(np.array(row["held_out"], bool), np.diff(first))[taken][order]
    counts = np.add.reduceat(trained.astype(np.int64), np.flatnonzero(new)) if len(at) else np.zeros(0, np.int64)
    return {"order": taken[order], "new": new, "counts": counts, "shard": shard[at].astype(np.int64), "context": names[context[at]], "customers": of[context[at]], "word": told[at], "numbers": numbers, "n": n, "first": first}


def packed_pairs(contexts: np.ndarray, runs: np.ndarray, customers: np.ndarray, words: np.ndarray, totals: np.ndarray, places: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Columns of a row of pairs: contexts with the lengths of their runs and customers, words with their training tokens,
    and each pair's place among the words (ascending in a run) and count."""
    steps = np.diff(places, prepend=np.zeros(1, np.int64))
    heads = np.cumsum(runs) - runs
    steps[heads] = places[heads]
    return [_pack(x) for x in (_differences(contexts), runs, customers, _differences(words), totals, steps, counts)]


def _rows_of_pairs(p: dict[str, np.ndarray], chunk: int, shards: int) -> Iterator[pa.RecordBatch]:
    borders = np.searchsorted(p["shard"], np.arange(2 * shards + 1))
    for j in np.flatnonzero(np.diff(borders)).tolist():
        at = slice(borders[j], borders[j + 1])
        u, w = p["context"][at], p["word"][at]
        run = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        own, places = np.unique(w, return_inverse=True)
        arrays = packed_pairs(u[run], np.diff(run, append=len(u)), p["customers"][at][run], p["numbers"][own], p["n"][own], places, p["counts"][at])
        yield pa.RecordBatch.from_pylist([dict(zip(_PAIRS.names, [j >> 1, bool(j & 1), chunk, *arrays], strict=True))], schema=_PAIRS)


def pair_rows(chunks: DataFrame, shards: int, wide: int, spread: bool | None = None) -> DataFrame:
    """Distinct (context, word) of each chunk with their training counts, as packed arrays for each shard: of the
    restaurants whose words lie in several places (``spread``), of the others, or of both in rows of their own."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if len(row["doc_ids"]):
                    yield from _rows_of_pairs(chunk_pairs(row, shards, wide, spread), row["chunk"], shards)
        release()

    return chunks.mapInArrow(pairs, _PAIR_TYPE)


def shard_pairs(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """A shard's restaurants and pairs in the order of their hashes, the pair of each entry of the rows, and the
    restaurant of each run of entries."""
    runs = [_unpack(r, np.int64) for r in rows["runs"]]
    of = np.repeat(np.arange(sum(map(len, runs))), np.concatenate(runs))
    contexts = np.concatenate([np.cumsum(_unpack(c, np.uint64), dtype=np.uint64) for c in rows["contexts"]])
    customers = np.concatenate([_unpack(x, np.int64) for x in rows["customers"]])
    words = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in rows["words"]]
    starts = np.cumsum([0, *map(len, words)])
    places = np.concatenate([_word_places(x, r) + k for x, r, k in zip(rows["places"], runs, starts.tolist(), strict=False)])
    own, first, rank = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
    counts = np.concatenate([_unpack(x, np.int64) for x in rows["counts"]])
    distinct, one, back = np.unique(contexts, return_index=True, return_inverse=True)
    # restaurant and rank of the word as one number
    key = back[of] * len(own) + rank[places]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    group, at = np.divmod(key[new], max(1, len(own)))
    c = np.bincount(pair, counts, len(group)).astype(np.int64)
    n = np.concatenate([_unpack(x, np.int64) for x in rows["totals"]])[first]
    return distinct, customers[one], group, own[at], n[at], c, pair, back


def _word_places(steps: bytes, runs: np.ndarray) -> np.ndarray:
    """Places of the pairs' words among those of their row, as ``packed_pairs`` has them."""
    places, heads = np.cumsum(_unpack(steps, np.int64)), np.cumsum(runs) - runs
    places -= np.repeat(np.concatenate([[0], places])[heads], runs)
    return places


def shard_seats(row: dict) -> tuple[np.ndarray, ...]:
    """The same of a shard whose pairs are added up: restaurants, customers, the restaurant of each pair, the shard's words
    with their training tokens, the word of each pair, and counts."""
    runs = _unpack(row["runs"], np.int64)
    contexts, words = (np.cumsum(_unpack(row[name], np.uint64), dtype=np.uint64) for name in ("contexts", "words"))
    group = np.repeat(np.arange(len(runs)), runs)
    return contexts, _unpack(row["customers"], np.int64), group, words, _unpack(row["totals"], np.int64), _word_places(row["places"], runs), _unpack(row["counts"], np.int64)


def wide_tables(state: DataFrame, tokens: int, words: int) -> DataFrame:
    """(shard, context, tables): tables after each sweep of the restaurants whose words lie in several places.

    Every sweep draws the tables of all places side by side and adds them up by context. ``state`` are their rows of
    pairs in buckets of the shards.
    """

    def one_sweep(sweep: int):
        def run(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            contexts, customers, group, w, n, c, _, _ = shard_pairs(rows)
            before = None
            if sweep:
                trail = dict(zip(known["context"].to_numpy().view(np.uint64).tolist(), known["tables"], strict=True))
                before = np.array([trail[u][-1] for u in contexts.tolist()], float)
            x = scale(sweep, contexts, customers, before)
            root = root_probability(n, tokens, words)
            t = draw_tables(c, DISCOUNT * x[group] * root, mix(contexts[group] ^ mix(w)), sweep, stirling_table(DISCOUNT))
            drawn = np.bincount(group, t, len(contexts)).astype(np.int64)
            return pd.DataFrame({"shard": key[0], "context": contexts.view(np.int64), "drawn": drawn, "trail": [list(trail[u]) if sweep else [] for u in contexts.tolist()]})

        return run

    known = state.sparkSession.createDataFrame([], "shard int, context long, tables array<long>")
    for sweep in range(BURN + SAMPLES):
        drawn = state.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(one_sweep(sweep), "shard int, context long, drawn long, trail array<long>")
        drawn = staged(drawn, "wide-drawn")
        total = drawn.groupBy("context").agg(F.sum("drawn").alias("total"))
        known = staged(drawn.join(total, "context").select("shard", "context", F.concat("trail", F.array("total")).alias("tables")), "wide-tables")
    return known


def shard_seatings(rows: pd.DataFrame, wide: pd.DataFrame, tokens: int, words: int) -> pd.DataFrame:
    """Customers of other chunks and further tables (beyond one a sweep) of one shard's pairs, and its restaurants'
    tables, for each chunk in the order in which it sent them."""
    contexts, customers, group, w, n, c, pair, restaurant = shard_pairs(rows)
    known = dict(zip(wide["context"].to_numpy(np.int64).view(np.uint64).tolist(), wide["tables"], strict=True))
    sums, all_sums = seatings(contexts, customers, group, w, c, root_probability(n, tokens, words), known)
    runs = [_unpack(r, np.uint32) for r in rows["runs"]]
    ends, run_ends = np.cumsum([int(r.sum()) for r in runs])[:-1], np.cumsum([len(r) for r in runs])[:-1]
    own = np.concatenate([_unpack(x, np.uint32) for x in rows["counts"]])
    out = {"customers": np.split(c[pair] - own, ends), "tables": np.split((sums - SAMPLES * (c > 0))[pair], ends), "all_tables": np.split(all_sums[restaurant], run_ends)}
    return pd.DataFrame({"chunk": rows["chunk"], "shard": 2 * rows["shard"] + rows["spread"], **{name: [_pack(x) for x in parts] for name, parts in out.items()}})


# ---- sweeps of the restaurants and of their root by turns ---------------------
def _tables_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _TABLES.split(", ")])


def _kept(known: pd.DataFrame, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables of a shard's restaurants after each sweep so far, and each pair's added up over the sampled ones; the last
    tables of the ``wide`` restaurants are those of all shards."""
    kept = known[known["block"] == KEPT].iloc[0]
    trail = _unpack(kept["tables"], np.int64).reshape(-1, len(wide))
    if wide.any():
        trail[-1, wide] = _unpack(known[known["block"] == CONTEXTS].iloc[0]["tables"], np.int64)
    return trail, _unpack(kept["customers"], np.int64)


def added_up(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's pairs over all chunks in one row, with the number of its words."""
    contexts, customers, group, w, n, c, _, _ = shard_pairs(rows)
    words, one, places = np.unique(w, return_index=True, return_inverse=True)
    arrays = packed_pairs(contexts, np.bincount(group, minlength=len(contexts)), customers, words, n[one], places, c)
    return pd.DataFrame([(rows["shard"].iloc[0], len(words), *arrays)], columns=["shard", "size", *_PAIRS.names[3:]])


def restaurant_sweep(rows: pd.DataFrame, known: pd.DataFrame, sweep: int, wide: int, blocks: int, distinct: int, words: int, root: tuple[int, int]) -> list[tuple]:
    """One sweep over a shard's restaurants: the tables of its words for each block, those of its wide restaurants, and
    what it keeps. ``root``: the root's customers and tables after its own sweep (its tokens before the first)."""
    contexts, customers, group, own, n, at, c = shard_seats(rows.iloc[0])
    shard, several = rows["shard"].iloc[0], customers > wide
    if sweep:
        trail, sums = _kept(known, several)
        parts = known[known["block"] >= 0].sort_values("block")
        seated, tables = (np.concatenate([_unpack(x, np.int64) for x in parts[name]]) for name in ("customers", "tables"))
        chance = root_probability(seated, root[0], words, tables, root[1])
    else:
        trail, sums = np.zeros((0, len(contexts)), np.int64), np.zeros(len(c), np.int64)
        chance = root_probability(n, root[0], words)
    x = scale(sweep, contexts, customers, trail[-1] if sweep else None)
    t = draw_tables(c, DISCOUNT * x[group] * chance[at], mix(contexts[group] ^ mix(own)[at]), sweep, stirling_table(DISCOUNT))
    drawn = np.bincount(group, t, len(contexts)).astype(np.int64)
    up = np.bincount(at, t, len(own)).astype(np.int64)
    out = [(shard, KEPT, None, _pack(sums + t if sweep >= BURN else sums), _pack(np.concatenate([trail.ravel(), drawn])), 0)]
    if several.any():
        out.append((shard, CONTEXTS, _pack(_differences(contexts[several])), None, _pack(drawn[several]), 0))
    for block, of in word_blocks(own, blocks, distinct):
        out.append((shard, block, _pack(_differences(own[of])), None, _pack(up[of]), int(up[of].sum())))
    return out


def word_blocks(numbers: np.ndarray, blocks: int, distinct: int) -> list[tuple[int, slice]]:
    """Blocks of ascending word numbers, of ``distinct`` in all, and where they stand."""
    cuts = np.searchsorted(numbers * np.uint64(blocks) // np.uint64(distinct), np.arange(blocks + 1)).tolist()
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def root_sweep(rows: pd.DataFrame, block: int, sweep: int, words: int, x: float) -> list[tuple]:
    """Tables sent up, added up by word and seated at the root: for each shard the customers and tables of its words, and
    in a row of no shard (-1) those of the whole block. Of contexts: their tables in all shards.

    ``x`` is the root's gamma variable.
    """
    sent = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in rows["words"]]
    names, at = np.unique(np.concatenate(sent), return_inverse=True)
    total = np.bincount(at, np.concatenate([_unpack(x, np.int64) for x in rows["tables"]]), len(names)).astype(np.int64)
    tables = total
    if block >= 0:
        weight = np.full(len(names), ROOT_DISCOUNT * x * 0.5 / words)
        tables = draw_tables(total, weight, mix(ROOT ^ mix(names)), sweep, stirling_table(ROOT_DISCOUNT), ROOT_DISCOUNT)
    parts = np.split(at, np.cumsum([len(s) for s in sent])[:-1])
    out = [(shard, block, None, _pack(total[p]) if block >= 0 else None, _pack(tables[p]), 0) for shard, p in zip(rows["shard"].tolist(), parts, strict=True)]
    if block >= 0:
        out.append((-1, block, _pack(_differences(names)), _pack(total), _pack(tables), int(tables.sum())))
    return out


def sampled(full: DataFrame, parts: DataFrame, shards: int, wide: int, tokens: int, words: int, distinct: int, size: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """For each chunk the seatings of its pairs (``shard`` from 0 on, as ``shard_seatings`` gives them, with the tables of
    each sampled sweep) and the customers and tables of its words at the root (``shard`` below 0) after each sampled
    sweep; and the root's customers and tables after these sweeps.

    ``size``: words of all chunks' vocabularies.
    """
    spark = full.sparkSession
    state = bucketed(pair_rows(full, shards, wide), "shard")
    columns = ", ".join(f"{c} binary" for c in _PAIRS.names[3:])
    seats = bucketed(state.groupBy("shard").applyInPandas(_freed(added_up), f"shard int, size long, {columns}"), "shard")
    blocks = max(1, -(-max(size, seats.agg(F.sum("size")).first()[0] or 0) // RANGE_WORDS))

    def restaurants(sweep: int, root: tuple[int, int]):
        return _freed(lambda rows, known: _tables_frame(restaurant_sweep(rows, known, sweep, wide, blocks, distinct, words, root)))

    def parents(sweep: int, x: float):
        return _freed(lambda rows: _tables_frame(root_sweep(rows, int(rows["block"].iloc[0]), sweep, words, x)))

    known, root, roots, read = spark.createDataFrame([], _TABLES), (tokens, 0), [], []
    for sweep in range(BURN + SAMPLES):
        drawn = staged(seats.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(restaurants(sweep, root), _TABLES), "drawn")
        discard(*read)
        customers = drawn.agg(F.sum("all_tables")).first()[0]
        shape = np.array([ROOT_CONCENTRATION / ROOT_DISCOUNT + root[1]])
        x = gamma(shape, np.array([ROOT]), sweep) if sweep else ROOT_CONCENTRATION / ROOT_DISCOUNT + np.array([float(customers)]) ** ROOT_DISCOUNT
        seated = staged(drawn.filter(F.col("block") != KEPT).groupBy("block").applyInPandas(parents(sweep, float(x[0])), _TABLES), "root-seated")
        root = (int(customers), int(seated.agg(F.sum("all_tables")).first()[0]))
        known = seated.filter("shard >= 0").unionByName(drawn.filter(F.col("block") == KEPT))
        read = [drawn] if sweep >= BURN else [drawn, seated]  # the sampled seatings of the root are read once more
        if sweep >= BURN:
            roots.append((root, seated.filter("shard < 0")))

    def pairs(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        contexts, customers, _, _, _, c, pair, restaurant = shard_pairs(rows)
        trail, sums = _kept(known, customers > wide)
        runs = [_unpack(r, np.uint32) for r in rows["runs"]]
        ends, run_ends = np.cumsum([int(r.sum()) for r in runs])[:-1], np.cumsum([len(r) for r in runs])[:-1]
        own = np.concatenate([_unpack(x, np.uint32) for x in rows["counts"]])
        out = {"customers": np.split(c[pair] - own, ends), "tables": np.split((sums - SAMPLES * (c > 0))[pair], ends), "all_tables": [trail[BURN:, r].ravel() for r in np.split(restaurant, run_ends)]}
        return pd.DataFrame({"chunk": rows["chunk"], "shard": 2 * rows["shard"] + rows["spread"], **{name: [_pack(x) for x in parts] for name, parts in out.items()}})

    def asks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, numbers = _totals(row)
                cut = word_blocks(numbers, blocks, distinct)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([row["chunk"]] * len(cut), pa.int64()), pa.array([_pack(_differences(numbers[of])) for _, of in cut], pa.binary())], ["block", "chunk", "words"])

    def answers(rows: pd.DataFrame, seated: pd.DataFrame) -> pd.DataFrame:
        seated = seated.sort_values("sweep")
        names = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in seated["words"]]
        counts = {name: [_unpack(x, np.int64) for x in seated[name]] for name in ("customers", "tables")}
        out = []
        for chunk, block, words in zip(rows["chunk"], rows["block"], rows["words"], strict=True):
            asked = np.cumsum(_unpack(words, np.uint64), dtype=np.uint64)
            at = [np.searchsorted(known, asked) for known in names]
            out.append((chunk, -1 - block, *[_pack(np.concatenate([x[i] for x, i in zip(counts[name], at, strict=True)])) for name in ("customers", "tables")], None))
        return pd.DataFrame(out, columns=["chunk", "shard", "customers", "tables", "all_tables"])

    seatings = state.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(_freed(pairs), _BACK)
    every = spark.createDataFrame([], f"{_TABLES}, sweep int")
    for k, (_, rows) in enumerate(roots):
        every = every.unionByName(rows.withColumn("sweep", F.lit(k)))
    asked = arrow_map(parts, asks, "block int, chunk long, words binary")
    at_root = asked.groupBy("block").cogroup(every.groupBy("block")).applyInPandas(_freed(answers), _BACK)
    return seatings.unionByName(at_root), [root for root, _ in roots]


def _freed(run):
    """``run`` of a group, with freed memory given back after it; the function tells Spark how many arguments it has."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = run(rows)
        release()
        return out

    def two(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = run(rows, known)
        release()
        return out

    return one if run.__code__.co_argcount == 1 else two


def score(docs: DataFrame, shard_pairs: int = SHARD_PAIRS, wide: int = WIDE, held: bool = True) -> DataFrame:
    """Per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``shard_pairs`` and ``wide`` spread the work; the scores are the same for all their values. ``held``: the root stays as
    all training tokens seat it, one table a word; otherwise it is sampled from the tables that its children send up.
    """
    chunks = bucketed(chunk_rows(docs), "chunk")
    totals = word_totals(chunks)
    tokens, words = (int(x or 0) for x in totals.agg(F.sum("tokens"), F.sum("words")).first())
    # one row for RANGE_WORDS words: small for the one task that adds them up
    offsets = totals.filter("distinct > 0").select("range", (F.sum("distinct").over(Window.orderBy("range")) - F.col("distinct")).alias("offset"))
    parts = totals.join(staged(offsets, "offsets"), "range").groupBy("chunk").agg(F.collect_list(F.struct("range", "offset", "n", "ranks")).alias("parts"))
    parts = bucketed(parts, "chunk")
    full = chunks.drop("counts", "size", "vocabulary").join(parts, "chunk")

    shards = max(1, -(-tokens * 5 // 4 // shard_pairs))  # four fifths of the tokens are for training

    def one_shard(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        seated = shard_seatings(rows, known, tokens, words)
        release()
        return seated

    roots: list[tuple[int, int]] = []
    if not held and words:
        size, distinct = chunks.agg(F.sum("size")).first()[0], totals.agg(F.sum("distinct")).first()[0]
        sums, roots = sampled(full, parts, shards, wide, tokens, words, distinct, size)
    else:
        none = pd.DataFrame({"context": np.zeros(0, np.int64), "tables": []})
        sums = pair_rows(full, shards, wide, spread=False).groupBy("shard").applyInPandas(lambda rows: one_shard(rows, none), _BACK)
        state = bucketed(pair_rows(full, shards, wide, spread=True), "shard")
        if not state.isEmpty():
            known = wide_tables(state, tokens, words)
            sums = sums.unionByName(state.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(one_shard, _BACK))
    sums = sums.groupBy("chunk").agg(F.collect_list(F.struct("shard", "customers", "tables", "all_tables")).alias("sums"))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = chunk_pairs(row, shards, wide)
                word, n, each = _unpack(row["words"], np.uint32), pairs["n"], np.diff(pairs["first"])
                m, doc = len(each), np.repeat(np.arange(len(each)), each)
                base = np.log10((n + 0.5) / (tokens + 0.5 * (words + 1)))[word]
                parts = sorted(row["sums"], key=lambda x: x["shard"])
                seats = [part for part in parts if part["shard"] >= 0]
                c, sums = (np.concatenate([_unpack(part[name], np.int64) for part in seats]) for name in ("customers", "tables"))
                c = c + pairs["counts"]
                sums = sums + SAMPLES * (c > 0)
                u, shard = pairs["context"], pairs["shard"]
                run = np.concatenate([[0], np.cumsum((u[1:] != u[:-1]) | (shard[1:] != shard[:-1]))])
                all_sums = np.concatenate([_unpack(part["all_tables"], np.int64).reshape(len(roots) or 1, -1) for part in seats], axis=1)
                if roots:
                    asked = [[_unpack(part[name], np.int64).reshape(SAMPLES, -1) for part in reversed(parts[: -len(seats)])] for name in ("customers", "tables")]
                    at_root = zip(*(np.concatenate(x, axis=1) for x in asked), roots, strict=True)
                    chances = (root_probability(seated, root[0], words, tables, root[1])[pairs["word"]] for seated, tables, root in at_root)
                    p = predictive_by_sweep(c, sums, pairs["customers"], ((tables[run], chance) for tables, chance in zip(all_sums, chances, strict=True)))
                else:
                    p = predictive(c, sums, all_sums[0][run], pairs["customers"], root_probability(n[pairs["word"]], tokens, words))
                value = np.empty(len(word))
                value[pairs["order"]] = np.log10(p)[np.cumsum(pairs["new"]) - 1]
                total = np.bincount(doc, value, m)
                arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(each), pa.array(np.bincount(doc, n[word] > 0, m).astype(np.int64)), pa.array(np.full(m, tokens)), pa.array(np.bincount(doc, base, m)), pa.array(total), pa.array(10.0 ** (-total / each))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
        release()

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return full.join(sums, "chunk", "left").mapInArrow(finish, out)
