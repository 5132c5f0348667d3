"""Text column functions: trimming, tokens, bigrams and clause blocks."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.functions.numerals import clause_ordinal
from clauselake.runtime import ship_by_value

ship_by_value(__name__)

_CONTROL_AND_SPACE = "".join(chr(i) for i in range(1, 33))
_BOUNDARY = rf"[{lx.HEADING_BOUNDARY}]|\p{{javaWhitespace}}|\z"
_NO_WORD = r"[^\p{L}\p{N}]+"
_HEADING = rf"第\s*([{lx.CLAUSE_DIGITS}]+)\s*条(?={_BOUNDARY})"


def trim_ws(c: Column) -> Column:
    """Strip spaces and control characters from both ends (ideographic space stays)."""
    return F.btrim(c, F.lit(_CONTROL_AND_SPACE))


def is_blank(c: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return c.isNull() | ~c.rlike(r"\P{javaWhitespace}")


def guarded_alternation(terms: list[str]) -> str:
    """Alternation of literal terms behind a check of their first characters.

    Most positions of a text fail that one check instead of every term.
    """
    firsts = "".join(sorted({re.escape(t[0]) for t in terms}))
    return f"(?=[{firsts}])(?:{lx.any_of(terms)})"


def contains_any(c: Column, terms: list[str]) -> Column:
    """True when at least one literal term occurs; null text counts as no."""
    return F.coalesce(c.rlike(guarded_alternation(terms)), F.lit(False))


def names_lacking(c: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """Names, in order, of the groups of literal words of which a text holds none; a null text holds no word.

    Arrow searches a batch of texts for a group in one pass; the alternation tries its words at every position of a text.
    """
    names, patterns = [name for name, _ in groups], ["|".join(map(re.escape, words)) for _, words in groups]

    @F.arrow_udf("array<string>")
    def lacking(texts: pa.Array) -> pa.Array:
        held = [pc.fill_null(pc.match_substring_regex(texts, p), False).to_numpy(zero_copy_only=False) for p in patterns]
        row, name = np.nonzero(~np.array(held).reshape(len(names), -1).T)
        ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(names, pa.string()).take(pa.array(name)))

    return lacking(c)


def word_tokens(c: Column) -> Column:
    """Lower-cased words; every Han character is a token of its own."""
    return F.filter(F.split(_spaced(c), _NO_WORD), lambda t: t != "")


def joined_tokens(c: Column) -> Column:
    """``word_tokens`` as one text with a space between two of them."""
    return F.btrim(F.regexp_replace(_spaced(c), _NO_WORD, " "))


def _spaced(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(\p{IsHan})", " $1 ")


def letters_only(c: Column) -> Column:
    """Letters and digits of a text, the input of ``char_bigrams``."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{Nd}]", "")


def char_bigrams(letters: Column) -> Column:
    """Distinct two-character grams; a lone character is its own gram.

    ``letters`` must be a plain column: the lambda reads it once per gram.
    """
    n = F.length(letters)
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n == 1, F.array(letters))
        .otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: letters.substr(i, F.lit(2))))
        )
    )


def heading_pieces(text: Column) -> Column:
    """Cut the text in front of every well-bounded clause heading; nothing is lost."""
    return F.split(text, f"(?={_HEADING})")


def heading_numbers(pieces: Column) -> Column:
    """Ordinal of the heading each piece starts with; null when it starts with none.

    The numerals are cut out first, so that a long piece is read once.
    """
    raws = F.transform(pieces, lambda piece: F.regexp_extract(piece, f"^{_HEADING}", 1))
    return F.transform(raws, lambda raw: F.when(raw != "", clause_ordinal(raw)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def accepted_starts(numbers: Column, max_jump: int = lx.MAX_HEADING_JUMP) -> Column:
    """Indexes of the pieces that open a clause.

    A heading counts unless it jumps more than ``max_jump`` past the last one
    that counted, so the decision depends on earlier decisions and is a fold.
    """
    start = F.struct(F.lit(-100).alias("last"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, i: Column) -> Column:
        number = F.get(numbers, i)
        take = number.isNotNull() & ~((acc["last"] >= 0) & (number - acc["last"] > max_jump))
        return F.when(
            take, F.struct(number.alias("last"), F.concat(acc["starts"], F.array(i)).alias("starts"))
        ).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.size(numbers) - 1), start, step, lambda acc: acc["starts"])


def long_clause_pieces(clause: Column) -> Column:
    """First cut of an over-long clause, untrimmed.

    At bracketed sub-marks when there are any - the text in front of the first
    mark is not kept - else at sentence ends.
    """
    by_mark = F.split(clause, f"(?={lx.SUB_MARK})")
    lead = F.when(clause.rlike(f"^{lx.SUB_MARK}"), 1).otherwise(2)
    sentences = F.filter(F.split(clause, "[；。]"), lambda s: s.rlike(r"[^\x00-\x20]"))
    # a clause has no more pieces than characters and one
    return F.when(clause.rlike(lx.SUB_MARK), F.slice(by_mark, lead, F.length(clause) + 1)).otherwise(sentences)


def replace_oversize(pieces: Column, clause: Column, limit: int = lx.MAX_CLAUSE_LEN) -> Column:
    """Fixed-width cuts of the whole clause when a single piece is still too long."""
    cuts = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(clause) - 1) / limit).cast("int")),
        lambda i: clause.substr(i * limit + 1, F.lit(limit)),
    )
    oversize = lambda p: (F.size(p) == 1) & (F.length(trim_ws(F.get(p, F.lit(0)))) > limit)
    return once(pieces, lambda p: F.when(oversize(p), cuts).otherwise(p))


def split_long_clause(clause: Column) -> Column:
    """Trimmed sub-blocks of one over-long clause."""
    return F.transform(replace_oversize(long_clause_pieces(clause), clause), trim_ws)


def clause_bodies(text: Column, label: Column, pieces: Column, numbers: Column, starts: Column) -> Column:
    """``array<struct<cid, body>>``: introduction and clauses, or the whole text without headings."""

    def body(cid: Column, content: Column) -> Column:
        return F.struct(cid.alias("cid"), content.alias("body"))

    def clause_at(start: Column, j: Column) -> Column:
        stop = F.coalesce(F.get(starts, j + 1), F.size(pieces))
        return body(
            F.concat(label, F.lit("-第"), F.get(numbers, start).cast("string"), F.lit("条")),
            trim_ws(F.array_join(F.slice(pieces, start + 1, stop - start), "")),
        )

    intro = trim_ws(F.get(pieces, F.lit(0)))
    none = F.array().cast("array<struct<cid:string,body:string>>")
    has_intro = F.get(numbers, F.lit(0)).isNull() & (intro != "")
    return (
        F.when(is_blank(text), none)
        .when(F.size(starts) == 0, F.array(body(F.concat(label, F.lit(lx.WHOLE_SUFFIX)), trim_ws(text))))
        .otherwise(
            F.concat(
                F.when(has_intro, F.array(body(F.concat(label, F.lit(lx.INTRO_SUFFIX)), intro))).otherwise(none),
                F.transform(starts, clause_at),
            )
        )
    )


def is_splittable(cid: Column, body: Column, limit: int = lx.MAX_CLAUSE_LEN) -> Column:
    """Only real clauses are cut further; introductions and whole texts stay as they are."""
    return (F.length(body) > limit) & ~cid.endswith(lx.INTRO_SUFFIX) & ~cid.endswith(lx.WHOLE_SUFFIX)


def block_count(clause: Column, limit: int = lx.MAX_CLAUSE_LEN) -> Column:
    """How many sub-blocks ``split_long_clause`` gives."""
    alone = lambda p: (F.size(p) == 1) & (F.length(trim_ws(F.get(p, F.lit(0)))) > limit)
    cuts = F.ceil(F.length(clause) / limit).cast("int")
    return once(long_clause_pieces(clause), lambda p: F.when(alone(p), cuts).otherwise(F.size(p)))


def body_sizes(bodies: Column) -> Column:
    """Number of blocks each body is cut into."""
    return F.transform(
        bodies, lambda b: F.when(is_splittable(b["cid"], b["body"]), block_count(b["body"])).otherwise(F.lit(1))
    )
