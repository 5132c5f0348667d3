"""Token-ID files: documents compressed one by one with a shared dictionary, and an offset index for short access.

File format. A folder holds ``dictionary/`` (one row: sha256, zstandard dictionary) and ``shards/`` (Parquet, one row
a shard, in ascending doc_id order by ``part`` and ``shard``). A shard's ``payload`` is, little-endian::

    4 bytes  magic "CLTK"         1 byte   bytes of an id (2 or 4)       32 bytes  sha256 of the dictionary
    u32      number of documents  u32[n]   ids of each document          u64[n + 1] byte offsets of the frames
    then one zstandard frame for each document (its ids, end id included)

Document ids stand beside the payload (``doc_ids``), so that the scan can skip shards by ``first_id`` / ``last_id``
and one frame can be read without its neighbours.

Cases: a null text is empty (only the end id); a null doc_id sorts first and is kept; repeated rows are documents of
their own; an empty table gives no shards and an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clauselake.llm import tokens
from clauselake.llm.common import arrow_map, text_of

MAGIC = b"CLTK"
#: ids in a shard, about
SHARD_IDS = 1 << 20
#: documents whose id arrays the dictionary is trained on, each of at most so many characters, and its bytes
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS, DICTIONARY_BYTES = 400, 20_000, 32 << 10
LEVEL = 3

_SHARDS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("shard_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)
_READ = "doc_id long, part int, shard int, in_shard long, n_tokens long, ids_crc32 long, ids binary"


def train_dictionary(docs: DataFrame, vocabulary: str) -> bytes:
    """Dictionary of a bounded sample of documents, chosen by the hash of the id; raw content where training needs more."""
    import zstandard

    chosen = (
        docs.filter(F.length("text") <= SAMPLE_CHARACTERS)
        .select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS).distinct()
    )
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").filter(F.length("text") <= SAMPLE_CHARACTERS)
    texts = sorted(r[0] for r in rows.select("text").limit(2 * SAMPLE_DOCUMENTS).collect())
    encoder = tokens.Encoder.load(vocabulary)
    width = 2 if len(encoder.starts) <= 1 << 16 else 4
    samples = [ids.astype(f"<u{width}").tobytes() for ids in tokens.documents_ids(encoder, pa.array(texts, pa.string()))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(samples)[:DICTIONARY_BYTES]


def pack_shard(arrays: list[np.ndarray], digest: bytes, compressor, width: int) -> bytes:
    frames = [compressor.compress(a.astype(f"<u{width}").tobytes()) for a in arrays]
    ends = np.cumsum([0, *map(len, frames)], dtype="<u8")
    head = MAGIC + struct.pack("<B", width) + digest + struct.pack("<I", len(arrays))
    return b"".join([head, np.array([len(a) for a in arrays], "<u4").tobytes(), ends.tobytes(), *frames])


class Shard:
    """A payload; ``ids(k)`` decompresses the k-th document alone."""

    def __init__(self, payload: bytes, digest: bytes, dictionary):
        import zstandard

        if payload[:4] != MAGIC or payload[5:37] != digest:
            raise ValueError("not a shard of this dictionary")
        self.width, n = payload[4], struct.unpack_from("<I", payload, 37)[0]
        self.lengths = np.frombuffer(payload, "<u4", n, 41)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, 41 + 4 * n) + np.uint64(41 + 4 * n + 8 * (n + 1))
        self.payload, self.decompressor = payload, zstandard.ZstdDecompressor(dict_data=dictionary)

    def ids(self, k: int) -> np.ndarray:
        frame = self.payload[int(self.offsets[k]) : int(self.offsets[k + 1])]
        raw = self.decompressor.decompress(frame, max_output_size=int(self.lengths[k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encode ``text`` of every row and write the folder ``path``."""
    spark, vocabulary = docs.sparkSession, vocabulary or tokens.default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    content = train_dictionary(docs, vocabulary)
    digest = hashlib.sha256(content).digest()
    spark.createDataFrame([(digest, content)], "sha256 binary, content binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = tokens.Encoder.load(vocabulary)
        width = 2 if len(encoder.starts) <= 1 << 16 else 4
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)
        part, shard = TaskContext.get().partitionId(), 0
        for batch in batches:
            held: list[tuple[int | None, np.ndarray]] = []
            size = 0
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.documents_ids(encoder, batch.column("text")), strict=True):
                if held and size + len(ids) > SHARD_IDS:
                    yield row(held, size, part, shard, compressor, width)
                    held, size, shard = [], 0, shard + 1
                held.append((doc_id, ids))
                size += len(ids)
            if held:
                yield row(held, size, part, shard, compressor, width)
                shard += 1

    def row(held, size: int, part: int, shard: int, compressor, width: int) -> pa.RecordBatch:
        doc_ids = [i for i, _ in held]
        known = [i for i in doc_ids if i is not None]
        payload = pack_shard([a for _, a in held], digest, compressor, width)
        values = [part, shard, min(known, default=None), max(known, default=None), size, doc_ids, payload]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, values, strict=True))], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("shard_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    arrow_map(ordered, shards, _SHARDS).write.option("compression", "uncompressed").parquet(f"{path}/shards")


def _decode(shards: DataFrame, path: str, wanted: frozenset[int] | None, with_ids: bool) -> DataFrame:
    digest, content = shards.sparkSession.read.parquet(f"{path}/dictionary").first()
    digest, content = bytes(digest), bytes(content)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        dictionary = zstandard.ZstdCompressionDict(content)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["payload"], digest, dictionary)
                before = np.cumsum(shard.lengths, dtype=np.int64) - shard.lengths
                out = []
                for k, doc_id in enumerate(row["doc_ids"]):
                    if wanted is None or doc_id in wanted:
                        ids = shard.ids(k)
                        out.append((doc_id, row["part"], row["shard"], int(before[k]), len(ids), tokens.crc(ids), ids.tobytes() if with_ids else None))
                names = ["doc_id", "part", "shard", "in_shard", "n_tokens", "ids_crc32", "ids"]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    return shards.select("part", "shard", "doc_ids", "payload").mapInArrow(read, _READ)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and its ids."""
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    sizes = shards.groupBy("part", "shard").agg(F.sum("shard_ids").alias("shard_ids"))
    parts = sizes.groupBy("part").agg(F.sum("shard_ids").alias("part_ids"))  # a row for each written partition
    before_part = F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before_shard = F.sum("shard_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.withColumn("in_part", F.coalesce(before_shard, F.lit(0))).join(
        parts.withColumn("to_part", F.coalesce(before_part, F.lit(0))), "part"
    )
    base = base.select("part", "shard", (F.col("to_part") + F.col("in_part")).alias("base"))
    rows = _decode(shards, path, None, with_ids).join(base, ["part", "shard"])
    kept = ["doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32"]
    return rows.select(*kept, *(["ids"] if with_ids else []))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of some documents: only shards that may hold them are scanned, only their own frames are decompressed."""
    within = F.lit(False)
    for i in doc_ids:
        within = within | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards").filter(within)
    return _decode(shards, path, frozenset(doc_ids), True).select("doc_id", "n_tokens", "ids_crc32", "ids")
