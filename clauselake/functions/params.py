"""Amounts, days and rates read from prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.functions.numerals import rate_digit
from clauselake.functions.text import contains_any

# --- fixed values: extraction patterns -------------------------------------
NUM = r"\d+(?:\.\d+)?"
WAN_YI = rf"({NUM})\s*(万|亿)"
YUAN = rf"({NUM})\s*元"
PRINCIPAL_FALLBACK = rf"本金\s*(?:是\s*)?({NUM})"
DAYS = r"(\d+)\s*天"
MONTHS = r"(\d+)\s*个?月"
YEARS = r"(\d+)\s*年"
PER_TEN_THOUSAND = "万分之([0-9零一二三四五六七八九十半两])"
PER_THOUSAND = "千分之([0-9零一二三四五六七八九十半两])"
PERCENT_RATE = rf"(?:日)?利率[^%]*?({NUM})\s*%"

_AMOUNT_TYPE = "struct<priority:int,pos:int,value:double>"


def _first_amount(text: Column, pattern: str, order: int, value_of) -> Column:
    """The match of ``pattern`` that ranks first by its context class, then by its place.

    Matches and the text between them are split out once; one pass over both
    carries the position, so the work grows with the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.split(text, pattern).alias("gap"), found.alias("hit"))

    def amount(hit: Column, start: Column, i: Column) -> Column:
        first = F.greatest(start - lx.CONTEXT_WINDOW, F.lit(0))
        context = text.substr(first + 1, start + F.length(hit) + lx.CONTEXT_WINDOW - first)
        priority = (
            F.when(contains_any(context, lx.EXCLUDED_CONTEXT), 2)
            .when(contains_any(context, lx.PRINCIPAL_CONTEXT), 0)
            .otherwise(1)
        )
        return F.struct(
            priority.cast("int").alias("priority"),
            (i + order).cast("int").alias("pos"),
            value_of(hit).alias("value"),
        )

    def step(s: Column, x: Column) -> Column:
        start = s["end"] + F.length(x["gap"])
        seen = F.when(x["hit"].isNotNull(), amount(x["hit"], start, s["i"]))
        return F.struct(
            (start + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("end"),
            (s["i"] + 1).alias("i"),
            F.when(s["best"].isNull() | (seen < s["best"]), seen).otherwise(s["best"]).alias("best"),
        )

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("i"), F.lit(None).cast(_AMOUNT_TYPE).alias("best"))
    return F.when(text.rlike(pattern), F.aggregate(steps, zero, step, lambda s: s["best"]))


def principal(text: Column) -> Column:
    """Principal in yuan.

    Among several amounts: the first near a penalty word, else the first in
    neutral context, else the first near an excluded word.  Windows may overlap.
    """

    def scaled(hit: Column) -> Column:
        unit = F.when(hit.endswith("亿"), F.lit(1e8)).otherwise(F.lit(1e4))
        return F.regexp_extract(hit, f"^({NUM})", 1).try_cast("double") * unit

    def plain(hit: Column) -> Column:
        return F.regexp_extract(hit, f"^({NUM})", 1).try_cast("double")

    best = F.array_min(
        F.array(_first_amount(text, WAN_YI, 0, scaled), _first_amount(text, YUAN, 1_000_000, plain))
    )["value"]
    fallback = F.regexp_extract(text, PRINCIPAL_FALLBACK, 1).try_cast("double")
    return F.when(text.rlike(r"\d"), F.coalesce(best, fallback))


def overdue_days(text: Column) -> Column:
    """Overdue days; explicit "not overdue" wording wins, then days, months, years."""

    def first_int(pattern: str) -> Column:
        return F.regexp_extract(text, pattern, 1).try_cast("int")

    return (
        F.when(contains_any(text, lx.NOT_OVERDUE), 0)
        .when(text.rlike(DAYS), first_int(DAYS))
        .when(text.contains("半年"), 180)
        .when(text.contains("一个半月"), 45)
        .when(text.contains("两个月"), 60)
        .when(text.rlike(MONTHS), F.try_multiply(first_int(MONTHS), F.lit(30)))
        .when(text.rlike(YEARS), F.try_multiply(first_int(YEARS), F.lit(365)))
        .cast("int")
    )


def stated_rate(text: Column) -> Column:
    """Daily rate in per mille as the text states it; null when it states none."""
    return (
        F.when(
            text.rlike(PER_TEN_THOUSAND), rate_digit(F.regexp_extract(text, PER_TEN_THOUSAND, 1)) / 10.0
        )
        .when(text.rlike(PER_THOUSAND), rate_digit(F.regexp_extract(text, PER_THOUSAND, 1)))
        .when(text.rlike(PERCENT_RATE), F.regexp_extract(text, PERCENT_RATE, 1).try_cast("double") * 10.0)
    )


def force_majeure(text: Column) -> Column:
    return F.coalesce(text.contains("不可抗力"), F.lit(False))


def penalty_context(text: Column) -> Column:
    return contains_any(text, lx.PENALTY_CONTEXT)


def daily_rate(text: Column) -> Column:
    """Stated rate, or the statutory default when the text speaks of a penalty."""
    return F.coalesce(stated_rate(text), F.when(penalty_context(text), F.lit(lx.DEFAULT_RATE_PER_MILLE)))


def param_columns(text: Column) -> list[Column]:
    """The six extracted parameters as aliased columns."""
    return [
        principal(text).alias("principal"),
        daily_rate(text).alias("rate_per_mille"),
        stated_rate(text).isNotNull().alias("rate_specified"),
        overdue_days(text).alias("days"),
        force_majeure(text).alias("force_majeure"),
        penalty_context(text).alias("penalty_context"),
    ]
