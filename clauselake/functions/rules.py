"""Rule cascades over one row: triage, gates, risk flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.functions import lexicons as lx
from clauselake.functions.calc import LOAN_INTEREST, normalize_rate
from clauselake.functions.numerals import ratio_number
from clauselake.functions.text import contains_any, is_blank, trim_ws

RATIO_PATTERN = "百分之([零一二三四五六七八九十百0-9]+)"
GRADE_PATTERN = r"(不?相关)\s*\|\s*([0-9.]+)"


# ---- triage ---------------------------------------------------------------
def hard_reject(q: Column) -> Column:
    return contains_any(q, lx.HARD_OUT_OF_SCOPE)


def review_intent(q: Column) -> Column:
    return contains_any(q, lx.REVIEW_ANCHORS)


def anchored_in_scope(q: Column) -> Column:
    return contains_any(q, lx.IN_SCOPE_ANCHORS)


def anaphoric_follow_up(q: Column) -> Column:
    return contains_any(q, lx.ANAPHORA_MARKERS) & ~contains_any(q, lx.CROSS_DOMAIN_WORDS)


def scope_verdict_rejects(raw: Column) -> Column:
    """Reject only on a clean out-of-scope answer; anything unclear passes."""
    t = F.lower(F.coalesce(raw, F.lit("")))
    return t.contains("out_of_scope") & ~t.contains("in_scope")


def scope_path(q: Column, has_history: Column) -> Column:
    """Which rule decides the scope: hard, review, anchor, anaphora or verdict."""
    return (
        F.when(hard_reject(q), "hard")
        .when(review_intent(q), "review")
        .when(anchored_in_scope(q), "anchor")
        .when(has_history & anaphoric_follow_up(q), "anaphora")
        .otherwise("verdict")
    )


def calc_triggered(q: Column) -> Column:
    return contains_any(q, lx.CALC_TRIGGERS)


def intent_from_verdict(raw: Column) -> Column:
    t = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(t.contains("both"), "both").when(t.contains("calc"), "calculate").otherwise("retrieve")


# ---- gates ----------------------------------------------------------------
def grade_score(raw: Column) -> Column:
    """Confidence of a relevance verdict; irrelevant or unreadable gives 0."""
    t = F.coalesce(raw, F.lit(""))
    label = F.regexp_extract(t, GRADE_PATTERN, 1)
    conf = F.regexp_extract(t, GRADE_PATTERN, 2).try_cast("double")
    return F.when(label == "相关", F.coalesce(conf, F.lit(0.0))).otherwise(F.lit(0.0))


def is_refusal(answer: Column) -> Column:
    return contains_any(answer, lx.REFUSAL_MARKS)


def heuristic_insufficient(answer: Column) -> Column:
    return is_blank(answer) | contains_any(answer, lx.FAILURE_MARKS)


def verdict_insufficient(raw: Column) -> Column:
    t = F.upper(trim_ws(F.coalesce(raw, F.lit(""))))
    return t.startswith("NO") | t.contains("不足") | t.contains("不充分")


# ---- contract review ------------------------------------------------------
def is_non_clause(canonical_id: Column) -> Column:
    return F.coalesce(
        canonical_id.endswith(lx.INTRO_SUFFIX) | canonical_id.endswith(lx.WHOLE_SUFFIX), F.lit(False)
    )


def clause_label(content: Column, canonical_id: Column) -> Column:
    found = F.regexp_extract(trim_ws(content), f"^(第[{lx.CLAUSE_DIGITS}]+条)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), canonical_id)


def penalty_ratio_anomaly(text: Column, cap: float = lx.PENALTY_RATIO_CAP) -> Column:
    """Agreed penalty share above the cap in penalty or late-fee context, else null."""
    ratio = ratio_number(F.regexp_extract(text, RATIO_PATTERN, 1)) / 100.0
    return F.when(contains_any(text, ["违约金", "滞纳金"]) & text.rlike(RATIO_PATTERN) & (ratio > cap), ratio)


def loan_rate_anomaly(
    calc_type: Column,
    rate_specified: Column,
    rate: Column,
    text: Column,
    cap: float = lx.LOAN_DAILY_CAP_PER_MILLE,
) -> Column:
    return F.coalesce(
        (calc_type == LOAN_INTEREST) & rate_specified & (normalize_rate(rate, text) > cap), F.lit(False)
    )


def free_text_risk(raw: Column) -> Column:
    """Risk reading of a free-text verdict; denials win, no text counts as a risk."""
    return (
        F.when(is_blank(raw), True)
        .when(contains_any(raw, lx.NO_RISK_PHRASES), False)
        .otherwise(contains_any(raw, lx.RISK_PHRASES))
    )


def review_point(raw: Column) -> Column:
    """Review dimension named by a verdict; unknown or missing reads as semantic."""
    out = F.when(raw.isNull(), "SEMANTIC")
    for name, label in lx.REVIEW_POINTS:
        out = out.when(raw.contains(label), name)
    return out.otherwise("SEMANTIC")


def risk_flag(point: Column, numeric_anomaly: Column, verdict_risky: Column, low_relevance: Column) -> Column:
    return F.when(point.isin("NUMERIC", "NONE"), numeric_anomaly).otherwise(verdict_risky | low_relevance)
