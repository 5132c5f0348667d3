"""Calculators: routing, penalty, loan interest, and the compute kernel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.functions.params import stated_rate
from clauselake.functions.text import contains_any

PENALTY = "PENALTY"
LOAN_INTEREST = "LOAN_INTEREST"


#: doubles from here on hold no cents that could be rounded
_NO_CENTS = 1e13
#: 2**27 + 1 splits a double into two halves whose products are exact
_SPLIT = 134217729.0


def cents_half_up(c: Column) -> Column:
    """Two decimals, half up on the exact binary value, as a decimal made from the double is rounded.

    The product with 100 is taken exactly as a double and its error, so a value
    just below a half cent stays below.  Null for infinite values.
    """

    def rounded(x: Column) -> Column:
        a = F.abs(x)
        cents = a * 100.0
        high = a * _SPLIT - (a * _SPLIT - a)
        error = (high * 100.0 - cents) + (a - high) * 100.0
        whole = F.floor(cents).cast("double")
        part = cents - whole
        up = F.when((part > 0.5) | ((part == 0.5) & (error >= 0)), 1.0).otherwise(0.0)
        exact = (whole + up) / 100.0 * F.when(x < 0, -1.0).otherwise(1.0)
        return F.when(a < _NO_CENTS, exact).when(a < float("inf"), x)

    return F.get(F.transform(F.array(c), rounded), F.lit(0))  # the value is computed once


def cents_nearest(c: Column) -> Column:
    """Two decimals as the nearest whole number of hundredths in floating point.  Null for infinite values."""

    def rounded(x: Column) -> Column:
        nearest = F.floor(x * 100.0 + 0.5).cast("double") / 100.0
        return F.when(F.abs(x) < _NO_CENTS, nearest).when(F.abs(x) < float("inf"), x)

    return F.get(F.transform(F.array(c), rounded), F.lit(0))


def explicit_calc_type(text: Column) -> Column:
    """Type the text decides alone; null when it defers to the previous turn."""
    return (
        F.when(contains_any(text, lx.LOAN_WORDS), LOAN_INTEREST)
        .when(contains_any(text, lx.REWRITE_CUES), F.lit(None).cast("string"))
        .otherwise(PENALTY)
    )


def route_calc(text: Column, previous: Column) -> Column:
    """Calculation type given the previous turn's type (null when there was none)."""
    return F.coalesce(explicit_calc_type(text), previous, F.lit(PENALTY))


def normalize_rate(rate: Column, context: Column) -> Column:
    """Repair a rate that is ten times too large.

    Rates up to 1 stay.  Otherwise the rate the context states wins; without
    one, a rate between 1 and 10 is read as a tenfold slip.
    """
    return F.when(rate <= 1.0, rate).otherwise(
        F.coalesce(stated_rate(context), F.when(rate < 10.0, rate / 10.0).otherwise(rate))
    )


def penalty_amount(principal: Column, rate: Column, days: Column, context: Column) -> Column:
    amount = cents_half_up(principal * (normalize_rate(rate, context) / 1000.0) * days)
    return F.when((principal >= 0) & (days >= 0), amount)


def interest_amount(
    principal: Column,
    rate: Column,
    days: Column,
    compound: bool = False,
    annual_cap: float = lx.LEGAL_ANNUAL_RATE_CAP,
) -> Column:
    annual = F.least(rate / 1000.0 * 365.0, F.when(rate.isNotNull(), F.lit(annual_cap)))
    if compound:
        raw = principal * (F.pow(F.lit(1.0) + annual / 365.0, days) - 1.0)
    else:
        raw = principal * annual * (days / 365.0)
    return F.when((principal >= 0) & (days >= 0), cents_nearest(raw))


def penalty_formula(principal: Column, rate: Column, days: Column, context: Column) -> Column:
    return F.concat(
        principal.cast("string"), F.lit(" × ("), normalize_rate(rate, context).cast("string"),
        F.lit("/1000) × "), days.cast("string"),
    )


def interest_formula(principal: Column, rate: Column, days: Column, context: Column) -> Column:
    annual = rate / 1000.0 * 365.0
    return F.format_string(
        "本金%.0f × 年化%.4f%% × %d/365（封顶 %.1f%%，原始年化 %.2f%%）",
        principal, F.least(annual, F.lit(lx.LEGAL_ANNUAL_RATE_CAP)) * 100.0, days,
        F.lit(lx.LEGAL_ANNUAL_RATE_CAP * 100.0), annual * 100.0,
    )


Calculator = Callable[[Column, Column, Column, Column], Column]

#: calculation type -> (amount, formula text); extend it through ``register``
CALCULATORS: dict[str, tuple[Calculator, Calculator]] = {
    LOAN_INTEREST: (lambda p, r, d, _: interest_amount(p, r, d), interest_formula),
    PENALTY: (penalty_amount, penalty_formula),
}


def register(calc_type: str, amount: Calculator, formula: Calculator) -> None:
    """Add or replace a calculator; dispatch is rebuilt on the next use."""
    CALCULATORS[calc_type] = (amount, formula)


def _dispatch(calc_type: Column, which: int, *args: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for name, pair in CALCULATORS.items():
        out = out.when(calc_type == name, pair[which](*args))
    return out


def compute_amount(
    calc_type: Column, principal: Column, rate: Column, days: Column, majeure: Column, text: Column
) -> Column:
    """Amount of one calculation: zero under force majeure, null when parameters are missing."""
    return F.when(majeure, F.lit(0.0)).otherwise(
        _dispatch(calc_type, 0, principal, rate, days, text).cast("double")
    )


def handoff_text(
    calc_type: Column,
    principal: Column,
    rate: Column,
    days: Column,
    majeure: Column,
    text: Column,
    amount: Column,
) -> Column:
    """Sentence that hands the amount to the answer."""
    done = F.format_string(
        "[%s] 本金%.0f元，日利率%.4g‰，%d天，金额=%.2f元（公式 %s）",
        calc_type, principal, rate, days, amount, _dispatch(calc_type, 1, principal, rate, days, text),
    )
    return (
        F.when(majeure, F.concat(F.lit("不可抗力免责（KB C3）：违约金=0元（问题："), text, F.lit("）")))
        .when(amount.isNotNull(), done)
        .when((principal > 0) & (days > 0), F.lit("（计算失败：参数不完整且 LLM 直算无结果）"))
        .otherwise(F.lit("（非金额计算语境，无需计算）"))
    )


def calc_argument_errors(principal: Column, rate: Column, days: Column) -> Column:
    """Violations of a calculation call, joined by ``; `` (empty text when valid)."""
    errors = F.array_compact(
        F.array(
            F.when(~(principal > 0), F.lit("principal 必须为正数")),
            F.when(~(rate > 0), F.lit("daily_rate_per_mille 必须为正数")).when(
                rate > lx.MAX_RATE_PER_MILLE,
                F.lit(f"daily_rate_per_mille 超出合理范围(<= {lx.MAX_RATE_PER_MILLE})"),
            ),
            F.when(~(days > 0), F.lit("days 必须为正整数")),
        )
    )
    return F.array_join(errors, "; ")
