"""Shared folders, staged tables, and the vectorised word hashing of several operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: bytes of text whose word hashes are computed at once; bounds the memory of a task
SLICE_BYTES = 2 << 20
#: rows of an Arrow batch of texts
BATCH_ROWS = 2000
_MASK = (1 << 64) - 1
#: odd multiplier of the polynomial hashes modulo 2**64, and its inverse
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if "dir" not in _fallback:
        _fallback["dir"] = tempfile.mkdtemp(prefix="clauselake-llm-")
    return _fallback["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder; removed when the driver program ends."""
    path = f"{shared_dir(spark)}/clauselake-llm/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has already ended; the folder's owner clears it
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Cuts the lineage: a lost executor makes later jobs read the files again and never repeat the stage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``staged`` has written, when nothing will read it again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, folder)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(names: list[str]) -> list[Column]:
    """Columns by their exact names, also those with dots."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def arrow_map(df: DataFrame, run, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches that stay small when rows are long texts; the session keeps this batch size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for tables with any column names: ``run`` meets and makes columns by their position alone."""
    names = [f"c{i}" for i in range(len(schema))]
    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema, strict=True)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), renamed, plain).toDF(*schema.names)


def text_of(df: DataFrame) -> Column:
    """The text column as string, null read as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def in_fold(doc_id: Column, folds: int, remainder: int = 1) -> Column:
    """True for documents whose crc32 of the id as text leaves ``remainder``; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == remainder, F.lit(False))


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint when the table has at most ``limit`` rows; beyond that the join is left to a shuffle."""
    return F.broadcast(df) if row_bound(df, limit) else df


def row_bound(df: DataFrame, limit: int) -> bool:
    """True when the table has at most ``limit`` rows."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def release() -> None:
    """Give freed memory back at a task's end; worker processes live on and would keep it beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    done, step = 1, base
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(step)
        done, step = done + m, step * step & _MASK
    return out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n + 1 byte offsets of the texts; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


#: ASCII upper case to lower case; all other bytes stay
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: space, and \x09 to \x0D
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def slice_end(data: np.ndarray, fresh: np.ndarray, at: int) -> int:
    """End of a slice of about SLICE_BYTES from ``at``, before white space or a text's start (``fresh``)."""
    end = min(len(data), at + SLICE_BYTES)
    while end < len(data) and not (fresh[end] or IS_SPACE[data[end]]):
        ahead = data[end : end + 4096]
        stop = np.flatnonzero(IS_SPACE[ahead] | fresh[end : end + len(ahead)])
        end += int(stop[0]) if len(stop) else len(ahead)
    return end


def word_table(texts: pa.Array, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, with A-Z lowered; ``gap`` may tell other bytes (white space among
    them) that lie between words.

    Returns their 64-bit hashes, their first bytes' places in ``text_buffer``, and per text the index of its
    first word (n + 1 entries). The hash is a polynomial in the word's bytes, mixed; equal words have equal hashes.
    """
    data, bounds = text_buffer(texts)
    hashes, places = [], []
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    at = 0
    while at < len(data):
        end = slice_end(data, fresh, at)
        part = data[at:end]
        space = gap[part]
        first = ~space
        first[1:] &= space[:-1] | fresh[at + 1 : end]
        starts = np.flatnonzero(first)
        if len(starts):
            tail = np.diff(starts, append=len(part))
            inside = np.arange(starts[0], len(part)) - np.repeat(starts, tail)
            value = powers(int(tail.max()))[inside] * (LOWER[part[starts[0] :]].astype(np.uint64) + np.uint64(1))
            value[space[starts[0] :]] = 0
            hashes.append(mix(np.add.reduceat(value, starts - starts[0])))
            places.append(starts + at)
        at = end
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), place, np.searchsorted(place, bounds)


def bounded(batch: pa.RecordBatch, column: str | int = "text", limit: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text, so that what is computed for a run stays small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, .. for each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
