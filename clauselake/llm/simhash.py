"""SimHash near-duplicates by pivot distance tables.

Fingerprints of all three-word shingles are compared through their Hamming distances to reference fingerprints. The
references with exactly two set bits, together with the zero fingerprint, give for each pair of bits how many are set:
``2 c = d(x, 0) - d(x, r) + 2``. Two fingerprints at three or fewer differing bits differ in at most three of these
32 coordinates, so out of six groups of coordinates three agree wholly: each choice of three groups is a join key.
Pairs under one key are discarded when their distances to any of further random references differ by more than the
bound (the triangle inequality), and the survivors are verified bit by bit.

Equal fingerprints are one class and are compared once. A key with many classes is cut into tiles of bounded size;
a tile returns one link for each class, not its pairs, so the output stays linear.

Cases: a null or blank text has fingerprint zero and links like any other; a null doc_id takes part (its group's
smallest known id counts, null when there is none); repeated rows share their class; an empty table gives an empty
result; further columns are ignored, and ``keep_one`` returns them as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauselake.llm.common import LOWER, fresh_name, map_batches, quoted, staged, text_of
from clauselake.llm.graph import components, local_star, whole_groups

SHINGLE, SEED, BOUND = 3, 42, 3
#: groups of pivot coordinates; all but BOUND of them agree
GROUPS = 6
#: classes of one key that a tile side holds
TILE = 4096
#: random reference fingerprints whose distances discard pairs
REFERENCES = np.random.default_rng(7).integers(0, 1 << 63, 16, dtype=np.int64)
#: hashes whose bits are counted at once
HASHES = 1 << 15
#: links kept before they are reduced to one for each node
LINKS = 1 << 21


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a text: bit k is set when over half of the shingles' hashes have it set."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(bytes(LOWER)).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[at : at + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], bits: str = "bits") -> DataFrame:
    """The kept columns and, as a signed long, the fingerprint of ``text``."""
    rows = docs.select(*quoted(keep), text_of(docs).alias(fresh_name(docs, "text_")))
    schema = T.StructType([*rows.schema[:-1], T.StructField(bits, T.LongType())])

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(len(keep))], np.uint64).view(np.int64)
            yield [*batch.columns[:-1], pa.array(found)]

    return map_batches(rows, compute, schema)


def pivot_coordinates(bits: Column) -> Column:
    """Set bits of each pair of bits, two bits a coordinate, as their distances to the two-bit references tell."""
    low = bits.bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(0x5555555555555555))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def key_masks(groups: int = GROUPS, bound: int = BOUND) -> list[int]:
    """Masks (signed) of the coordinates of every choice of groups that may agree wholly."""
    pairs = np.array_split(np.arange(32), groups)
    single = [sum(3 << (2 * int(p)) for p in group) for group in pairs]
    masks = [sum(chosen) for chosen in itertools.combinations(single, groups - bound)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints ``bits``, one for each linked fingerprint and tile."""
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("pivot").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(key_masks())])
    keyed = classes.select("bits", pivot_coordinates(F.col("bits")).alias("pivot"))
    keyed = keyed.select("bits", F.explode(choices).alias("k")).select("bits", "k.choice", "k.key")
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = keyed.join(shared, ["choice", "key"])
    rows = rows.withColumn("tiles", F.ceil(F.col("n") / TILE)).withColumn("own", F.pmod(F.xxhash64("bits"), F.col("tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("choice", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "bits")
    keys = ["choice", "key", "low", "high"]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, keys):
            bits = table.column("bits").to_numpy()
            distances = np.stack([np.bitwise_count((bits ^ r).view(np.uint64)) for r in REFERENCES], axis=1).astype(np.int8)
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            at, step = np.arange(len(bits) - 1), 1
            while len(at):
                at = at[at + step < len(bits)]
                at = at[group[at] == group[at + step]]
                near = at
                for p in range(distances.shape[1]):
                    near = near[np.abs(distances[near, p] - distances[near + step, p]) <= BOUND]
                near = near[np.bitwise_count((bits[near] ^ bits[near + step]).view(np.uint64)) <= BOUND]
                a, b = np.concatenate([a, bits[near]]), np.concatenate([b, bits[near + step]])
                if len(a) > LINKS:
                    a, b = local_star(a, b)
                step += 1
            if len(a):
                a, b = local_star(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (hex), component_id, and ``cluster``, the signed root fingerprint of its group."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return grouped(staged(fingerprints(ids, ["doc_id"]), "fingerprints"))


def grouped(rows: DataFrame) -> DataFrame:
    classes = rows.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    found = components(links(classes))
    linked = staged(found.join(classes, found["node"] == classes["bits"]).select("node", "component", "first_id"), "linked")
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(lowest, "component").select(F.col("node").alias("bits"), "component", "component_id")
    classes = classes.join(linked, "bits", "left").select(
        "bits", F.coalesce("component", "bits").alias("cluster"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    out = rows.join(classes, "bits")
    return out.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id", "cluster")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without their near-duplicates: of each group one row with the smallest doc_id stays."""
    columns, key = docs.columns, fresh_name(docs, "simhash_id")
    named = docs.withColumn(key, F.col("doc_id").cast("long"))
    bits = fresh_name(named, "simhash_bits")
    rows = staged(fingerprints(named, [*columns, key], bits), "documents-with-fingerprints")
    groups = grouped(rows.select(F.col(key).alias("doc_id"), F.col(bits).alias("bits")))
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.groupBy("cluster").agg(F.min(F.struct("doc_id", "fingerprint")).alias("k"), F.count("*").alias("n"))
    kept = kept.select(F.col("k.doc_id").alias("kept_id"), F.conv("k.fingerprint", 16, -10).cast("long").alias("kept_bits"), "n")
    kept = staged(kept, "kept")
    out = rows.join(kept, rows[key].eqNullSafe(kept["kept_id"]) & (rows[bits] == kept["kept_bits"]), "left_semi")
    if kept.filter("n > 1").limit(1).count():  # repeated rows: equal in id and fingerprint
        out = out.dropDuplicates([key, bits])
    return out.select(*quoted(columns))
