"""Chinese numerals: clause ordinals, ratio numerals, and money capitals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: numeral characters -------------------------------------
SIMPLE_DIGITS = "零一二三四五六七八九"
RATE_DIGITS = {
    "零": 0.0, "一": 1.0, "二": 2.0, "两": 2.0, "三": 3.0, "四": 4.0, "五": 5.0,
    "六": 6.0, "七": 7.0, "八": 8.0, "九": 9.0, "十": 10.0, "半": 0.5,
}
RATIO_DIGITS = {1: "一壹", 2: "二两贰", 3: "三叁", 4: "四肆", 5: "五伍", 6: "六陆", 7: "七柒", 8: "八捌", 9: "九玖"}
CAPITAL_DIGITS = "壹贰叁肆伍陆柒捌玖"
CAPITAL_UNITS = ["仟", "佰", "拾", ""]
CAPITAL_GROUPS = ["亿", "万", ""]


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda ch: ch != "")


def _value_of(ch: Column, table: list[tuple[str, int]]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for chars, value in table:
        out = out.when(ch.isin(*chars), F.lit(value))
    return out


def clause_ordinal(c: Column) -> Column:
    """Clause number with 十 / 百 / 千 place values or plain digits; unknown characters give 0."""
    table = [(ch, i) for i, ch in enumerate(SIMPLE_DIGITS)] + [("十", 10), ("百", 100), ("千", 1000)]
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("pending"), F.lit(True).alias("ok"))

    def step(acc: Column, ch: Column) -> Column:
        v = _value_of(ch, table)
        unit = F.struct(
            (acc["total"] + F.greatest(acc["pending"], F.lit(1)) * v).alias("total"),
            F.lit(0).alias("pending"),
            acc["ok"].alias("ok"),
        )
        digit = F.struct(acc["total"].alias("total"), v.alias("pending"), acc["ok"].alias("ok"))
        bad = F.struct(acc["total"].alias("total"), acc["pending"].alias("pending"), F.lit(False).alias("ok"))
        return F.when(v.isNull(), bad).when(v >= 10, unit).otherwise(digit)

    han = F.aggregate(
        _chars(c), start, step, lambda acc: F.when(acc["ok"], acc["total"] + acc["pending"]).otherwise(0)
    )
    return F.when(c.rlike("^[0-9]+$"), F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(han)


def ratio_number(c: Column) -> Column:
    """Number in a percentage phrase; 零 and other unknown characters give null.

    From the first ASCII digit on, the rest of the text must be a plain number.
    """
    table = [(chars, value) for value, chars in RATIO_DIGITS.items()] + [("十拾", 10), ("百佰", 100)]
    start = F.struct(
        F.lit(0).alias("hundreds"), F.lit(0).alias("tens"), F.lit(0).alias("digit"), F.lit(True).alias("ok")
    )

    def step(acc: Column, ch: Column) -> Column:
        v = _value_of(ch, table)
        count = F.when(acc["digit"] == 0, 1).otherwise(acc["digit"])

        def to(hundreds: Column, tens: Column, digit: Column, ok: Column) -> Column:
            return F.struct(
                hundreds.alias("hundreds"), tens.alias("tens"), digit.alias("digit"), ok.alias("ok")
            )

        zero = F.lit(0)
        return (
            F.when(v.isNull(), to(acc["hundreds"], acc["tens"], acc["digit"], F.lit(False)))
            .when(v == 100, to(acc["hundreds"] + count * 100, zero, zero, acc["ok"]))
            .when(v == 10, to(acc["hundreds"], acc["tens"] + count * 10, zero, acc["ok"]))
            .otherwise(to(acc["hundreds"], acc["tens"], v, acc["ok"]))
        )

    def total(acc: Column) -> Column:
        return F.when(acc["ok"], (acc["hundreds"] + acc["tens"] + acc["digit"]).cast("double"))

    head = F.regexp_extract(c, "^([^0-9]*)", 1)
    tail = F.regexp_extract(c, "^[^0-9]*(.*)$", 1)
    han = F.aggregate(_chars(head), start, step, total)
    return F.when(
        c.isNotNull() & (c != ""),
        F.when(tail == "", han).when(han.isNotNull(), tail.try_cast("double")),
    )


def rate_digit(c: Column) -> Column:
    """Value of the one numeral after 万分之 / 千分之 (Chinese or ASCII digit)."""
    out = F.when(c.rlike("^[0-9]$"), c.try_cast("double"))
    for ch, value in RATE_DIGITS.items():
        out = out.when(c == ch, F.lit(value))
    return out


def money_capitals(amount: Column) -> Column:
    """Amount in Chinese capitals; null amount reads as zero, above 12 integer digits gives null.

    Zeros between two groups of four are not spelled, only zeros inside a group.
    """
    value = F.coalesce(amount, F.lit(0)).try_cast("decimal(18,2)")
    plain = F.abs(value).cast("string")
    integer = F.substring_index(plain, ".", 1)
    cents = F.substring_index(plain, ".", -1)
    digits = F.lpad(integer, 12, "0")

    def group(i: int) -> Column:
        parts = []
        for j, unit in enumerate(CAPITAL_UNITS):
            d = digits.substr(i * 4 + j + 1, 1)
            parts.append(F.when(d == "0", F.lit("0")).otherwise(F.concat(_capital(d), F.lit(unit))))
        joined = F.btrim(F.concat(*parts), F.lit("0"))
        return F.regexp_replace(joined, "0+", "零")

    spelled = []
    for i, unit in enumerate(CAPITAL_GROUPS):
        g = group(i)
        spelled.append(F.when(g == "", F.lit("")).otherwise(F.concat(g, F.lit(unit))))
    whole = F.concat(*spelled)
    jiao, fen = cents.substr(1, 1), cents.substr(2, 1)
    tail = F.when(cents == "00", F.lit("整")).otherwise(
        F.concat(
            F.when(jiao == "0", F.lit("")).otherwise(F.concat(_capital(jiao), F.lit("角"))),
            F.when(fen == "0", F.lit(""))
            .otherwise(F.concat(F.when(jiao == "0", F.lit("零")).otherwise(F.lit("")), _capital(fen), F.lit("分"))),
        )
    )
    sign = F.when(value < 0, F.lit("负")).otherwise(F.lit(""))
    text = F.concat(sign, F.when(whole == "", F.lit("零")).otherwise(whole), F.lit("元"), tail)
    return F.when(F.length(integer) <= 12, text)


def _capital(d: Column) -> Column:
    return F.translate(d, "123456789", CAPITAL_DIGITS)
