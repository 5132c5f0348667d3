"""Letters from templates and request rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.numerals import money_capitals
from clauselake.functions.text import is_blank
from clauselake.runtime import broadcast_if_small

# --- fixed values: placeholder names and default texts ----------------------
REFUND_TEXT = [
    "recipientName", "recipientId", "recipientAddress", "recipientPhone",
    "senderName", "senderId", "senderAddress", "senderPhone",
    "contractNumber", "bankAccountName", "bankName", "bankAccountNumber",
]
COMPLAINT_TEXT = [
    "complainantName", "complainantPhone", "complainantId", "complainantAddress", "complainantEmail",
    "businessName", "businessCreditCode", "businessAddress", "businessPhone", "businessPersonInCharge",
    "purchaseLocation", "productServiceName", "productServiceDetail", "paymentMethod", "receiptNumber",
    "complaintReason", "purchaseMethod", "communicationContent", "problemDescription", "sceneDescription",
    "contactMethod", "firstResponse", "subsequentContactMethod", "subsequentResponse",
]
COMPLAINT_DATES = ["purchase", "service", "discovery", "firstContact"]
COMPLAINT_AMOUNTS = ["totalPrice", "purchasePrice", "economicLoss", "compensationRequest", "mentalDamages"]
NO_AMOUNT = "______"
NO_CAPITALS = "________________________元整"
NO_DATE = "________年____月____日"
NO_REASON = "________________________________________________________"
TERMINATION_KINDS = {"按期终止": "一", "协议解除": "二", "其他原因": "三"}
ENDED = ("前述合同/协议已于", "按期终止/解除，且我方已完全履行合同项下全部义务，不存在任何违约行为。")
AGREED = ("我方与您/贵方已通过《解除协议》一致同意解除原合同，并约定您/贵方应在", "前返还上述押金。")
OTHER = ("其他情况：", "。")
DEFAULT_ATTACHMENTS = (
    "1. 购买凭证复印件（收据/发票/支付记录）\n2. 商品/服务问题照片或视频\n3. 与商家沟通记录截图\n4. 商家承诺相关证明材料\n"
)


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


class _Request:
    """Columns of a request table; a column the table lacks reads as null."""

    def __init__(self, df: DataFrame):
        self.columns = set(df.columns)

    def col(self, name: str, kind: str = "string") -> Column:
        column = _snake(name)
        return F.col(column) if column in self.columns else F.lit(None).cast(kind)

    def text(self, name: str, default: str = "") -> Column:
        c = self.col(name)
        return F.when(is_blank(c), F.lit(default)).otherwise(c)

    def amount(self, name: str) -> Column:
        c = self.col(name, "decimal(18,2)").try_cast("decimal(18,2)")
        return F.coalesce(c.cast("string"), F.lit(NO_AMOUNT))

    def capitals(self, name: str) -> Column:
        c = self.col(name, "decimal(18,2)").try_cast("decimal(18,2)")
        given = self.col(name + "Chinese")
        spelled = F.when(c.isNotNull(), money_capitals(c)).otherwise(F.lit(NO_CAPITALS))
        return F.when(is_blank(given), spelled).otherwise(given)

    def date(self, year: str, month: str, day: str) -> Column:
        y, m, d = (self.col(n) for n in (year, month, day))
        return (
            F.when(is_blank(y), F.lit(NO_DATE))
            .when(is_blank(m), F.concat(y, F.lit("年____月____日")))
            .when(is_blank(d), F.concat(y, F.lit("年"), m, F.lit("月____日")))
            .otherwise(F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日")))
        )


def _two_digits(c: Column) -> Column:
    return F.when(F.length(c) == 1, F.concat(F.lit("0"), c)).otherwise(c)


def _padded_number(c: Column) -> Column:
    number = F.coalesce(F.trim(c).try_cast("int"), F.lit(0))
    return F.when(is_blank(c), F.lit("__")).otherwise(F.format_string("%02d", number))


def refund_fields(requests: DataFrame, today: Column) -> dict[str, Column]:
    """Placeholder values of a deposit-refund letter.  ``today`` is used when no send date is given."""
    r = _Request(requests)
    kind = F.coalesce(r.col("terminationType"), F.lit(""))
    label = F.lit("____")
    for name, numeral in reversed(TERMINATION_KINDS.items()):
        label = F.when(kind == name, F.lit(numeral)).otherwise(label)

    def choice(chosen: str, text: tuple[str, str], filled: Column, blank: str) -> Column:
        return F.when(
            kind == chosen, F.concat(F.lit("☑" + text[0]), filled, F.lit(text[1]))
        ).otherwise(F.lit("□" + text[0] + blank + text[1]))

    reason = F.concat(
        F.lit("\r\n"),
        choice("按期终止", ENDED, r.date("terminationYear1", "terminationMonth1", "terminationDay1"), NO_DATE),
        F.lit("\r\n\r\n"),
        choice("协议解除", AGREED, r.date("terminationYear2", "terminationMonth2", "terminationDay2"), NO_DATE),
        F.lit("\r\n\r\n"),
        choice("其他原因", OTHER, r.text("otherReason", NO_REASON), NO_REASON),
    )
    sent = F.when(is_blank(r.col("sendDate")), F.date_format(today, "yyyy年MM月dd日")).otherwise(r.col("sendDate"))
    month = F.regexp_extract(sent, "^[^年]*年([^年月]+)", 1)
    day = F.replace(F.regexp_extract(sent, "^[^月]*月([^月]+)", 1), F.lit("日"), F.lit(""))
    return {
        **{name: r.text(name) for name in REFUND_TEXT},
        "contractYear": r.text("contractYear", "____"),
        "contractMonth": _padded_number(r.col("contractMonth")),
        "contractDay": _padded_number(r.col("contractDay")),
        "contractName": r.text("contractName", "合同/协议"),
        "depositAmount": r.amount("depositAmount"),
        "depositAmountChinese": r.capitals("depositAmount"),
        "terminationTypeChinese": label,
        "terminationReasonContent": reason,
        "deadlineDays": F.coalesce(r.col("deadlineDays", "int").cast("string"), F.lit("____")),
        "sendYear": F.regexp_extract(sent, "^([^年]*)", 1),
        "sendMonth": F.when(month == "", F.lit("__")).otherwise(_two_digits(month)),
        "sendDay": F.when(day == "", F.lit("__")).otherwise(_two_digits(day)),
        "senderNameSign": r.text("senderName"),
        "attachments": r.text("contractName", "______"),
    }


def complaint_fields(requests: DataFrame, today: Column) -> dict[str, Column]:
    """Placeholder values of a consumer complaint."""
    r = _Request(requests)
    days = r.col("serviceCompletionDays", "int").cast("string")
    pledge = F.when(
        is_blank(r.col("businessCommitment")),
        F.concat(F.lit("如商品质保1年、7天无理由退货、服务在"), F.coalesce(days, F.lit("____")), F.lit("日内完成等")),
    ).otherwise(F.replace(r.col("businessCommitment"), F.lit("${serviceCompletionDays}"), F.coalesce(days, F.lit("____"))))
    out = {name: r.text(name) for name in COMPLAINT_TEXT}
    for prefix in COMPLAINT_DATES:
        out[f"{prefix}Year"] = r.text(f"{prefix}Year", "____")
        for part in ("Month", "Day") + (() if prefix == "purchase" else ("Hour",)):
            out[f"{prefix}{part}"] = r.text(f"{prefix}{part}", "__")
    for name in COMPLAINT_AMOUNTS:
        out[name] = r.amount(name)
    out["totalPriceChinese"] = r.capitals("totalPrice")
    out["economicLossChinese"] = r.capitals("economicLoss")
    out["businessCommitment"] = pledge
    out["serviceCompletionDays"] = F.coalesce(days, F.lit("____"))
    out["subsequentDate1"] = r.text("subsequentDate1", "____年__月__日")
    out["subsequentDate2"] = r.text("subsequentDate2", "____月__日")
    out["attachmentList"] = r.text("attachmentList", DEFAULT_ATTACHMENTS)
    out["complaintDate"] = F.when(
        is_blank(r.col("complaintDate")), F.date_format(today, "yyyy年MM月dd日")
    ).otherwise(r.col("complaintDate"))
    return out


FIELD_BUILDERS = {"deposit_refund": refund_fields, "consumer_complaint": complaint_fields}


def render_letters(requests: DataFrame, templates: DataFrame, kind: str, today: Column) -> DataFrame:
    """Fill templates (``template_id, kind, body``): ``request_id, letter, letter_base64, letter_bytes``.

    Values become columns first; placeholders the template does not use cost nothing after pruning.
    """
    fields = FIELD_BUILDERS[kind](requests, today)
    values = requests.select("request_id", "template_id", *[v.alias(f"v_{n}") for n, v in fields.items()])
    body = F.col("body")
    for name in fields:
        body = F.replace(body, F.lit("${" + name + "}"), F.col(f"v_{name}"))
    chosen = broadcast_if_small(templates.filter(F.col("kind") == kind).select("template_id", "body"))
    filled = values.join(chosen, "template_id").select("request_id", "template_id", body.alias("letter"))
    encoded = F.encode("letter", "UTF-8")
    return filled.withColumn("letter_base64", F.regexp_replace(F.base64(encoded), r"\s", "")).withColumn(
        "letter_bytes", F.octet_length(encoded)
    )
