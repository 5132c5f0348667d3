"""Line dedup by deletion neighbourhoods: of lines within one word of each other the earliest stays.

A line is its sequence of words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. Lines are equal when these sequences are, and
near when one word is replaced, added or left out and the shorter has at least ``min_words`` words (below that, one word
is too much of a line). A line goes when an equal or near line occurs earlier, by (doc_id, content of the document,
line number); lines without words always stay. What earlier lines went does not matter.

Deletion neighbourhood: a line's variants are the line itself and the line without each of its words. Replacing one
word leaves equal variants with the word deleted at one place; adding a word makes a variant equal to the whole other
line. So lines are joined on (variant, place) and on (variant, whole line), where the members of a key are near one
another or to the key's whole line. Only the earliest of a key matters to the rest, so a key with very many lines
gives one candidate a line, never pairs. The candidates' edit distances are verified on their words.

Variants are only made for lines that can have a partner: one edit leaves a half of the words as it was, so a line
whose first and last halves no other line shares has none.

Cases: a null text stays null and has no lines; a null doc_id sorts first; rows equal in doc_id and text count as one
document and all keep the same lines; an empty table gives an empty result; all columns are kept and ``text`` is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauselake.llm.common import (
    BASE_INVERSE, arrow_map, bounded, fresh_name, map_batches, mix, powers, quoted, ragged, small_side, staged, text_buffer, word_table,
)

#: words that a line needs for near matches
MIN_WORDS = 10
#: documents with candidate lines that are broadcast at most; more are joined by a shuffle
BROADCAST_DOCUMENTS = 100_000
#: keys (a hash or two) that are broadcast at most; more are joined by a shuffle
BROADCAST_KEYS = 500_000
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_LINES = "doc_id long, uid long, line int, words int, k1 long, k2 long, halves array<long>"
_VARIANTS = "k1 long, k2 long, doc_id long, uid long, line int, place int, variant long, w binary"


def _long(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and for each line with words: its text's index, its line number, its first word (n + 1 entries)."""
    hashes, places, _ = word_table(texts)
    data, bounds = text_buffer(texts)
    breaks = np.flatnonzero(data == 10)
    # a line begins after a line break and at the start of a text; empty texts begin where the next one does
    heads = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    of_word = np.searchsorted(heads, places, side="right") - 1
    new = np.flatnonzero(np.diff(of_word, prepend=-1))
    doc = np.searchsorted(bounds, places[new], side="right") - 1
    number = np.searchsorted(breaks, places[new]) - np.searchsorted(breaks, bounds[doc])
    return hashes, doc, number, np.append(new, len(hashes))


def prefix_hashes(words: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Entry i: polynomial hash of all words before i."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)])


def _spans(prefix: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the words a..b-1, the same wherever they stand."""
    return mix((prefix[b] - prefix[a]) * inverse[a])


def line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for every line with words: its key (two hashes) and the hashes of its halves."""

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole)):
            words, doc, number, first = line_words(batch.column("text"))
            power, inverse = powers(len(words)), powers(len(words) + 1, BASE_INVERSE)
            a, b = first[:-1], first[1:]
            n = b - a
            prefix = prefix_hashes(words, power)
            k1 = _spans(prefix, inverse, a, b)
            k2 = _spans(prefix_hashes(mix(words ^ _SECOND), power), inverse, a, b)
            halves = []
            for h in (n // 2, (n - 1) // 2):
                for x, y, side in ((a, a + h, 1), (b - h, b, 2)):
                    halves.append(mix(_spans(prefix, inverse, x, y) ^ mix(h.astype(np.uint64) * np.uint64(4) + np.uint64(side))))
            long_enough = n + 1 >= min_words
            halves = np.stack([_long(h) for h in halves], axis=1)[long_enough]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(long_enough, 4, 0))]), pa.int32()), pa.array(halves.ravel())
            )
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("uid").take(take), pa.array(number, pa.int32()), pa.array(n, pa.int32()), pa.array(_long(k1)), pa.array(_long(k2)), lists],
                ["doc_id", "uid", "line", "words", "k1", "k2", "halves"],
            )

    return arrow_map(docs.select("doc_id", "uid", F.coalesce("text", F.lit("")).alias("text")), lines, _LINES)


def variant_rows(docs: DataFrame) -> DataFrame:
    """Variants of the lines listed in ``wanted``: place -1 is the whole line, which also carries its word hashes."""

    def variants(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole)):
            words, doc, number, first = line_words(batch.column("text"))
            asked = batch.column("wanted")
            owner = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
            listed = set(zip(owner.tolist(), asked.flatten().field("line").to_pylist(), strict=True))
            if not listed:
                continue
            chosen = np.array([p in listed for p in zip(doc.tolist(), number.tolist(), strict=True)], bool)
            power, inverse = powers(len(words)), powers(len(words) + 1, BASE_INVERSE)
            prefix = prefix_hashes(words, power)
            second = prefix_hashes(mix(words ^ _SECOND), power)
            a, b = first[:-1][chosen], first[1:][chosen]
            n = b - a
            line = np.repeat(np.arange(len(a)), n)
            out = ragged(a, n)  # the word that is left out
            start, end = np.repeat(a, n), np.repeat(b, n)
            left = prefix[out] - prefix[start]
            right = (prefix[end] - prefix[out + 1]) * np.uint64(BASE_INVERSE)
            cut = mix((left + right) * inverse[start])
            which = np.concatenate([np.arange(len(a)), line])
            whole = [words[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            take = pa.array(doc[chosen][which])
            k1, k2 = _spans(prefix, inverse, a, b), _spans(second, inverse, a, b)
            table = pa.RecordBatch.from_arrays(
                [pa.array(_long(k1)[which]), pa.array(_long(k2)[which]), batch.column("doc_id").take(take), batch.column("uid").take(take), pa.array(number[chosen][which], pa.int32()),
                 pa.array(np.concatenate([np.full(len(a), -1), out - start]), pa.int32()), pa.array(_long(np.concatenate([k1, cut]))), pa.array([*whole, *[None] * len(line)], pa.binary())],
                ["k1", "k2", "doc_id", "uid", "line", "place", "variant", "w"],
            )
            for at in range(0, table.num_rows, 100_000):
                yield table.slice(at, 100_000)

    return arrow_map(docs, variants, _VARIANTS)


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Edit distance of two word sequences is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m = len(short)
    differ = np.flatnonzero(short != long[:m])
    at = int(differ[0]) if len(differ) else m
    rest = at + 1 if len(a) == len(b) else at
    return bool(np.array_equal(short[rest:], long[at + 1 :]))


def _place() -> Column:
    return F.struct("doc_id", "uid", "line")


def first_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines that stay: doc_id, uid, line. ``docs`` has doc_id, uid and text."""
    rows = line_rows(docs, min_words)
    lines = rows.groupBy("k1", "k2").agg(F.min(_place()).alias("at"), F.first("halves").alias("halves"), F.first("words").alias("words"))
    lines = staged(lines, "lines")

    halves = lines.select("k1", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low < high").select("half")
    shared = staged(shared, "shared-halves")
    candidates = staged(halves.join(small_side(shared, BROADCAST_KEYS), "half", "left_semi").select("k1").distinct(), "candidate-keys")
    wanted = lines.join(small_side(candidates, BROADCAST_KEYS), "k1", "left_semi").select("at.*")
    wanted = staged(wanted.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("line")).alias("wanted")), "candidates")
    side = small_side(wanted.select(F.col("doc_id").alias("_d"), F.col("uid").alias("_u"), "wanted"), BROADCAST_DOCUMENTS)
    texts = docs.join(side, docs["doc_id"].eqNullSafe(F.col("_d")) & (docs["uid"] == F.col("_u")))
    # rows equal in id and text would give each variant again
    variants = staged(variant_rows(texts.select("doc_id", "uid", "text", "wanted")), "variants")
    # most variants belong to one line alone; only the variants' hashes are shuffled to find the others
    common = variants.groupBy("variant").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low < high").select("variant")
    common = small_side(staged(common, "shared-variants"), BROADCAST_KEYS)

    placed = variants.join(common, "variant", "left_semi").select("k1", "k2", "place", "variant", F.struct("doc_id", "uid", "line").alias("at"))
    placed = staged(placed, "placed")
    replaced = placed.filter("place >= 0").groupBy("variant", "place").agg(F.min(F.struct("at", "k1", "k2")).alias("first"), F.count("*").alias("n"))
    later = placed.filter("place >= 0").join(replaced.filter("n > 1"), ["variant", "place"])
    pairs = later.filter("at > first.at").select("k1", "k2", F.col("first.k1").alias("e1"), F.col("first.k2").alias("e2"))
    whole = placed.filter("place < 0").groupBy("variant").agg(F.min(F.struct("at", "k1", "k2")).alias("whole"))
    added = placed.filter("place >= 0").join(whole, "variant")
    longer = added.filter("at > whole.at").select("k1", "k2", F.col("whole.k1").alias("e1"), F.col("whole.k2").alias("e2"))
    shorter = added.filter("at < whole.at").groupBy(F.col("whole.k1").alias("k1"), F.col("whole.k2").alias("k2"))
    shorter = shorter.agg(F.min(F.struct("at", "k1", "k2")).alias("f")).select("k1", "k2", F.col("f.k1").alias("e1"), F.col("f.k2").alias("e2"))
    found = pairs.unionByName(longer).unionByName(shorter).distinct()

    texts = variants.filter("place < 0").groupBy("k1", "k2").agg(F.first("w").alias("w"))
    early = texts.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("w").alias("v"))
    checked = found.join(texts, ["k1", "k2"]).join(early, ["e1", "e2"]).select("k1", "k2", "w", "v")
    least = min_words

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("w").to_pylist(), batch.column("v").to_pylist(), strict=True)]
            near = pa.array([min(len(x), len(y)) >= least and within_one(x, y) for x, y in both], pa.bool_())
            yield batch.select(["k1", "k2"]).filter(near)

    near = staged(checked.mapInArrow(verify, "k1 long, k2 long").distinct(), "near-lines")
    return lines.join(small_side(near, BROADCAST_KEYS), ["k1", "k2"], "left_anti").select("at.*")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns, ``text`` without its repeated lines, and n_lines and n_removed (lines before, lines gone).

    Where the table has columns of these names, the new ones get underscores behind theirs.
    """
    names = docs.columns
    counts = [fresh_name(docs, "n_lines"), fresh_name(docs, "n_removed")]
    key, uid = fresh_name(docs, "line_id"), fresh_name(docs, "line_uid")
    named = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(uid, F.xxhash64("doc_id", "text"))
    kept = first_lines(named.select(F.col(key).alias("doc_id"), F.col(uid).alias("uid"), F.col("text").cast("string").alias("text")), min_words)
    held = fresh_name(named, "kept_lines")
    kept = kept.groupBy(F.col("doc_id").alias(f"{held}_id"), F.col("uid").alias(f"{held}_uid")).agg(F.collect_list("line").alias(held))
    joined = named.join(kept, named[key].eqNullSafe(kept[f"{held}_id"]) & (named[uid] == kept[f"{held}_uid"]), "left")
    schema = T.StructType([*docs.schema, *[T.StructField(c, T.IntegerType()) for c in counts]])
    at = names.index("text")

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in (part for whole in batches for part in bounded(whole, at)):
            texts, before, gone = [], [], []
            for text, kept_lines in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                parts, keep = (text or "").split("\n"), set(kept_lines or ())
                stay = [p for i, p in enumerate(parts) if i in keep or not p.strip(" \t\n\x0b\x0c\r")]
                texts.append(None if text is None else "\n".join(stay))
                before.append(len(parts) if text is not None else 0)
                gone.append(len(parts) - len(stay))
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, columns[at].type)
            yield [*columns, pa.array(before, pa.int32()), pa.array(gone, pa.int32())]

    return map_batches(joined.select(*quoted([*names, held])), rebuild, schema)
