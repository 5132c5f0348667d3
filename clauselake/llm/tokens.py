"""Byte-level BPE ids of whole texts with the tokenizers library, each distinct space-delimited piece encoded once.

The vocabulary's pre-tokeniser always starts a new pre-token at a space that a non-space character follows, so a text
may be cut there without changing its ids. Pieces that recur in a batch are encoded once. Texts in which a space is
followed by white space or by the end, or that hold the special token's string, are encoded as they are.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from clauselake.llm.common import ragged

#: id appended to every document
END = 0
#: bytes of text whose pieces are encoded together
GROUP_BYTES = 4 << 20
#: pieces joined into one string for the library
JOIN_PIECES = 2000
#: repeated pieces whose ids a worker process keeps for its later batches
KEPT_PIECES = 400_000
#: a cut is safe before a space that a non-space follows
CUT = re.compile(r" (?=\S)")
#: fixed pattern: white space of the pre-tokeniser after a space, a space at the end, or the special token
UNSAFE = (
    "[ ][\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    "|[ ]\\z|<\\|endoftext\\|>"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of many texts. ``starts`` marks the ids whose token begins with a space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.starts[i] = token.startswith("Ġ")  # the byte alphabet's letter for a space
        self.kept = pa.array([], pa.large_string())
        self.kept_ids, self.kept_lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    @staticmethod
    def load(path: str) -> Encoder:
        """One encoder for each worker process; tasks that follow one another share it."""
        kept = sys.__dict__.setdefault("_clauselake_encoders", {})
        if path not in kept:
            kept[path] = Encoder(path)
        return kept[path]

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths, by the library alone."""
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), np.array([len(x) for x in found], np.int64)

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word with a space before it. Each word starts at an id whose token starts with a space."""
        flat = []
        for i in range(0, len(words), JOIN_PIECES):
            joined = " " + " ".join(words[i : i + JOIN_PIECES].to_pylist())
            flat.append(np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        first = np.flatnonzero(self.starts[ids])
        if len(first) != len(words):
            return self.plain([" " + w for w in words.to_pylist()])
        return ids, np.diff(first, append=len(ids))

    def _known(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first places and lengths of the words' ids; pieces seen before come from the kept ones."""
        at = pc.index_in(words, value_set=self.kept).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = at < 0
        ids, lengths = self._pieces(words.filter(pa.array(fresh)))
        kept_first = np.cumsum(self.kept_lengths) - self.kept_lengths
        first, each = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[~fresh], each[~fresh] = kept_first[at[~fresh]], self.kept_lengths[at[~fresh]]
        first[fresh], each[fresh] = len(self.kept_ids) + np.cumsum(lengths) - lengths, lengths
        pool = np.concatenate([self.kept_ids, ids])
        again = np.flatnonzero(fresh & (counts > 1))[: KEPT_PIECES - len(self.kept)]
        if len(again):
            self.kept = pa.concat_arrays([self.kept, words.take(pa.array(again))])
            self.kept_ids = np.concatenate([self.kept_ids, pool[ragged(first[again], each[again])]])
            self.kept_lengths = np.concatenate([self.kept_lengths, each[again]])
        return pool, first, each

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For consecutive runs of the texts, their flat ids and the number of ids of each; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // GROUP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield self._group(texts[a:b])

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        odd, even = np.flatnonzero(unsafe), np.flatnonzero(~unsafe)
        split = pc.split_pattern(texts.take(pa.array(even)), " ")
        words_each = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = np.cumsum(words_each) - words_each  # the first word of a text has no space before it
        tail = np.ones(len(code), bool)
        tail[heads] = False
        counts = np.bincount(code[tail], minlength=len(coded.dictionary))
        used = counts > 0
        ids, firsts, lengths = self._known(coded.dictionary.filter(pa.array(used)), counts[used])
        place = np.cumsum(used) - 1
        first_words = coded.dictionary.take(pa.array(code[heads])).to_pylist()
        head_lengths = np.zeros(len(first_words), np.int64)
        said = np.flatnonzero([bool(w) for w in first_words])  # a text that starts with a space has none
        head_ids, head_lengths[said] = self.plain([first_words[i] for i in said])
        whole_ids, whole_lengths = self.plain(texts.take(pa.array(odd)).to_pylist())
        # sources, one after the other: pieces, heads, whole texts; every text is a run of spans of them
        pool = np.concatenate([ids, head_ids, whole_ids])
        span_start = np.concatenate([firsts, len(ids) + np.cumsum(head_lengths) - head_lengths])
        span_length = np.concatenate([lengths, head_lengths])
        span = np.where(tail, place[code], 0)
        span[heads] = len(lengths) + np.arange(len(heads))
        each = np.zeros(len(texts), np.int64)
        each[even] = np.add.reduceat(span_length[span], heads) if len(heads) else 0
        each[odd] = whole_lengths
        even_ids = pool[ragged(span_start[span], span_length[span])]
        if not len(odd):
            return even_ids, each
        out = np.empty(int(each.sum()), np.uint32)
        first = np.cumsum(each) - each
        out[ragged(first[even], each[even])] = even_ids
        out[ragged(first[odd], each[odd])] = whole_ids
        return out, each


def documents_ids(encoder: Encoder, texts: pa.Array) -> Iterator[np.ndarray]:
    """Ids of each text, with the end id, as little-endian unsigned 32-bit integers."""
    for flat, each in encoder.encode(texts):
        ends = np.cumsum(each)
        for e, n in zip(ends.tolist(), each.tolist(), strict=True):
            yield np.append(flat[e - n : e], np.uint32(END)).astype("<u4")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
