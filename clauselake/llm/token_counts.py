"""Token counts that follow edits: a tree of segment counts per document, re-encoded only where edits touch it.

A text is cut into segments at places where the vocabulary's pre-tokeniser always starts anew (before a space or line
break that a non-space follows, but for the special token; a run without such places is one segment). A segment's ids do not depend on its neighbours, so the count of a text is the sum over segments.
Segments are kept in blocks; a binary tree holds the characters and tokens of every subtree. An edit (place, characters
to take out, characters to put in, in the text as earlier edits left it) goes down the tree to the blocks it touches;
their text is changed, a block whose start is no safe place any more is joined with the block before it (the boundary
context), only these blocks are encoded again, and the sums on the paths to the root are updated. A block that edits made
longer than twice ``BLOCK`` is cut anew and the tree is built over the new blocks.

The edit log of a document is applied in order inside one row's task; the documents' logs are joined by doc_id. A log is
one list, as edits depend on one another.

Cases: a null text is empty; a null doc_id has no edits; rows that repeat a doc_id each get its edits; edits with a null
place or of documents that do not exist do nothing; places beyond the text are moved to its end, negative ones to its
start, a null length is 0, a null replacement is empty; ties in ``edit_no`` are ordered by place, length and
replacement; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm import tokens
from clauselake.llm.common import arrow_map, text_of

#: characters of a block, about
BLOCK = 160
#: a place where the ids of a text begin anew, whatever stands before it
CUT = re.compile(r"[ \n](?=\S)(?!<\|endoftext\|>)")
_COUNTS = "doc_id long, n_edits int, tokens_before long, tokens_after long, chars_after long, chars_encoded long"


class CountTree:
    """Characters and tokens of a text's blocks, with sums over a binary tree."""

    def __init__(self, encoder: tokens.Encoder, blocks: list[str], counts: list[int]):
        self.encoder, self.encoded = encoder, 0
        self._build(blocks, counts)

    def _build(self, blocks: list[str], counts: list[int]) -> None:
        self.blocks = blocks
        self.size = 1 << max(0, (len(blocks) - 1).bit_length())
        self.chars, self.tokens = ([0] * (2 * self.size) for _ in range(2))
        self.chars[self.size : self.size + len(blocks)] = map(len, blocks)
        self.tokens[self.size : self.size + len(blocks)] = counts
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _set(self, block: int, text: str, count: int) -> None:
        self.blocks[block] = text
        node = self.size + block
        self.chars[node], self.tokens[node] = len(text), count
        while node > 1:
            node //= 2
            self._sum(node)

    def _find(self, place: int) -> tuple[int, int]:
        """Block of a place and the place inside it; the text's end belongs to the last block that is not empty."""
        node = 1
        while node < self.size:
            node *= 2
            # stay left at a border only when nothing follows
            if place > self.chars[node] or (place == self.chars[node] and self.chars[node + 1]):
                place -= self.chars[node]
                node += 1
        return node - self.size, place

    def _before(self, block: int) -> int:
        """The nearest block to the left that holds text, or -1."""
        block -= 1
        while block >= 0 and not self.blocks[block]:
            block -= 1
        return block

    def edit(self, place: int, length: int, replacement: str) -> None:
        place = min(max(place, 0), self.chars[1])
        length = min(max(length, 0), self.chars[1] - place)
        first, inside = self._find(place)
        last, end = self._find(place + length)
        if last > first:
            changed = self.blocks[first][:inside] + replacement + self.blocks[last][end:]
        else:
            changed = self.blocks[first][:inside] + replacement + self.blocks[first][inside + length :]
        for k in range(first + 1, last + 1):
            self._set(k, "", 0)
        # boundary context: a block must start at a safe place, unless it starts the text
        start = first
        while changed and not CUT.match(changed) and (before := self._before(start)) >= 0:
            changed = self.blocks[before] + changed
            self._set(start, "", 0)
            start = before
        self.encoded += len(changed)
        pieces = blocks_of(changed) if len(changed) > 2 * BLOCK else [changed]
        counts = [len(self.encoder.tokenizer.encode(p, add_special_tokens=False).ids) if p else 0 for p in pieces]
        if len(pieces) == 1:
            self._set(start, changed, counts[0])
            return
        known = self.tokens[self.size : self.size + len(self.blocks)]
        blocks, tokens_of = [*self.blocks[:start], *pieces, *self.blocks[start + 1 :]], [*known[:start], *counts, *known[start + 1 :]]
        held = [k for k, b in enumerate(blocks) if b]
        self._build([blocks[k] for k in held], [tokens_of[k] for k in held])

    @property
    def total(self) -> tuple[int, int]:
        return self.tokens[1], self.chars[1]


def blocks_of(text: str, size: int = BLOCK) -> list[str]:
    """The text cut at safe places into blocks of about ``size`` characters."""
    out, at = [], 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def _edit(number: Column, place: Column, length: Column, replacement: Column) -> Column:
    return F.struct(
        number.cast("long").alias("edit_no"), place.cast("long").alias("place"), F.coalesce(length.cast("long"), F.lit(0)).alias("length"),
        F.coalesce(replacement.cast("string"), F.lit("")).alias("replacement"),
    )


def count_edited(docs: DataFrame, edits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: n_edits, tokens before and after its edits, characters after, and characters encoded for edits.

    ``edits``: doc_id, edit_no, place, length, replacement.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()
    log = _edit(*(F.col(c) for c in ("edit_no", "place", "length", "replacement")))
    logs = edits.filter("place IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    logs = logs.agg(F.array_sort(F.collect_list(log)).alias("log"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).join(logs, "doc_id", "left")
    return _counted(rows, vocabulary)


def count_with_log(docs: DataFrame, log: str, vocabulary: str | None = None) -> DataFrame:
    """As ``count_edited``, for documents that carry their edits in the array column ``log``: no join, no shuffle.

    The edits of a row are its own, whatever its doc_id; null edits and edits with a null place do nothing.
    """
    placed = F.filter(F.col(log), lambda e: e["place"].isNotNull())
    edits = F.array_sort(F.transform(placed, lambda e: _edit(*(e[f] for f in ("edit_no", "place", "length", "replacement")))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), edits.alias("log"))
    return _counted(rows, vocabulary or tokens.default_vocabulary())


def _counted(rows: DataFrame, vocabulary: str) -> DataFrame:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder.load(vocabulary)
        for batch in batches:
            out, held, size = [], [], 0
            texts, ids, logs = (batch.column(c).to_pylist() for c in ("text", "doc_id", "log"))
            for row in zip(ids, texts, logs, strict=True):
                held.append((row[0], blocks_of(row[1]), row[2] or []))
                size += len(row[1])
                if size >= tokens.GROUP_BYTES:
                    out, held, size = out + follow(encoder, held), [], 0
            out += follow(encoder, held)
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            names = ["doc_id", "n_edits", "tokens_before", "tokens_after", "chars_after", "chars_encoded"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    def follow(encoder: tokens.Encoder, held: list) -> list[tuple]:
        flat = pa.array([b for _, blocks, _ in held for b in blocks], pa.large_string())
        counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in encoder.encode(flat))]).tolist()
        out, at = [], 0
        for doc_id, blocks, log in held:
            tree = CountTree(encoder, blocks, counts[at : at + len(blocks)])
            at += len(blocks)
            before = tree.total[0]
            for e in log:
                tree.edit(e["place"], e["length"], e["replacement"])
            out.append((doc_id, len(log), before, *tree.total, tree.encoded))
        return out

    return arrow_map(rows, count, _COUNTS)
