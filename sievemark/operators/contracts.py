"""Contracts: amounts in financial capitals and back, and what a draft lacks as findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..exprs import col

# The digits, and the units within a section of four digits and of the sections.
DIGITS, UNITS, SECTIONS = "零壹贰叁肆伍陆柒捌玖", ("仟", "佰", "拾", ""), ("兆", "亿", "万", "")
MOST = 10 ** (4 * len(SECTIONS))


def capital_integer(value: Column) -> Column:
    """A whole number below MOST in financial capitals.

    Every digit is written with its unit; then zeros give up theirs, runs of them become one, a section without digits
    gives up its own unit, and zeros at the end of a section or of the number go.
    """
    def spell(digits: Column) -> Column:
        pieces = []
        for s, section in enumerate(SECTIONS):
            for u, unit in enumerate(UNITS):
                pieces += [F.translate(F.substring(digits, 4 * s + u + 1, 1), "0123456789", DIGITS), F.lit(unit)]
            pieces.append(F.lit(section))
        return F.concat(*pieces)

    text = F.get(F.transform(F.array(F.lpad(value.cast("decimal(20,0)").cast("string"), 16, "0")), spell), F.lit(0))
    text = F.regexp_replace(text, "零[仟佰拾]", "零")
    text = F.regexp_replace(text, "^(?:零+[兆亿万]?)+", "")
    for before, section in (("兆", "亿"), ("[兆亿]", "万")):  # a section of zeros after a larger one
        text = F.regexp_replace(text, f"({before})零{{4}}{section}", "$1零")
    text = F.regexp_replace(F.regexp_replace(text, "零+", "零"), "零([兆亿万])", "$1")
    text = F.regexp_replace(text, "([兆亿])零?万", "$1零")
    text = F.rtrim(F.regexp_replace(text, "零+", "零"), F.lit("零"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("零"))


def capital_amount(amount: str | Column) -> Column:
    """An amount of yuan in financial capitals, rounded half up to fen; null below 0 and from MOST on."""
    value = F.round(col(amount).cast("decimal(24,6)"), 2).cast("decimal(20,2)")
    whole = F.floor(value)
    fen = ((value - whole) * 100).cast("int")
    digit = lambda d: F.substring(F.lit(DIGITS), d + 1, F.lit(1))
    jiao, rest = F.floor(fen / 10).cast("int"), fen % 10
    tail = F.when(fen == 0, "整").otherwise(F.concat(F.when(jiao > 0, F.concat(digit(jiao), F.lit("角"))).otherwise("零"), F.when(rest > 0, F.concat(digit(rest), F.lit("分"))).otherwise("")))
    return F.when((value >= 0) & (value < MOST), F.concat(F.lit("人民币"), capital_integer(whole), F.lit("元"), tail))


#: Sections of at most four digits with their units, a whole amount, and what may stand around it.
_GROUP = "(?:[壹贰叁肆伍陆柒捌玖]仟)?零?(?:[壹贰叁肆伍陆柒捌玖]佰)?零?(?:[壹贰叁肆伍陆柒捌玖]?拾)?零?[壹贰叁肆伍陆柒捌玖]?"
_AMOUNT = f"^(?:人民币)?(?:({_GROUP})兆)?零?(?:({_GROUP})亿)?零?(?:({_GROUP})万)?零?({_GROUP})零?[元圆](?:整|正|零?(?:([壹贰叁肆伍陆柒捌玖])角)?零?(?:([壹贰叁肆伍陆柒捌玖])分)?(?:整|正)?)$"


def capital_value(text: str | Column) -> Column:
    """The amount that financial capitals say, as decimal(20,2); null where they don't follow the number's grammar."""
    plain = lambda c: F.translate(c, DIGITS, "0123456789")
    money = lambda c: c.cast("decimal(20,2)")
    one = lambda c: F.coalesce(money(F.nullif(plain(c), F.lit(""))), money(F.lit(0)))

    def section(g: Column) -> Column:
        tens = F.when(g.rlike("(?:^|零)拾"), 1).otherwise(0)  # a ten without its one
        return one(F.regexp_extract(g, "([^零])仟", 1)) * 1000 + one(F.regexp_extract(g, "([^零])佰", 1)) * 100 + (one(F.regexp_extract(g, "([^零仟佰])拾", 1)) + tens) * 10 + one(F.regexp_extract(g, "([^零仟佰拾])$", 1))

    def value(said: Column) -> Column:
        part = lambda i: F.regexp_extract(said, _AMOUNT, i)
        whole = F.aggregate(F.array(*[part(i + 1) for i in range(len(SECTIONS))]), money(F.lit(0)), lambda a, g: money(a * 10_000 + section(g)))
        return F.when(said.rlike(_AMOUNT), money(whole + one(part(5)) / 10 + one(part(6)) / 100))

    said = F.regexp_replace(F.regexp_replace(col(text), r"(?U)\s", ""), "^((?:人民币)?)零([元圆])", "$1$2")
    return F.get(F.transform(F.array(said), value), F.lit(0))  # so that the text is cleaned once


# Codes, levels and messages of a contract's findings.
FINDINGS = {
    "INVALID_SERVICE_PERIOD": ("error", "服务结束日期必须晚于开始日期。"),
    "MISSING_PURCHASER_CREDIT_CODE": ("warning", "采购人统一社会信用代码缺失。"),
    "MISSING_PURCHASER_ADDRESS": ("warning", "采购人地址缺失。"),
    "MISSING_SUPPLIER_CREDIT_CODE": ("warning", "供应商统一社会信用代码缺失。"),
    "MISSING_SUPPLIER_ADDRESS": ("warning", "供应商地址缺失。"),
    "MISSING_BREACH_TERMS": ("warning", "违约责任条款尚未提供，已使用待补充提示。"),
    "LEGAL_REVIEW_REQUIRED": ("info", "合同定稿前必须由业务及法务人员复核。"),
}


def contract_findings(contracts: DataFrame, key: str) -> DataFrame:
    """CTR-01: (key, code, level, message, requires_human_review), in the order of FINDINGS, for each contract.

    contracts: key, service_start, service_end, purchaser_code, purchaser_address, supplier_code, supplier_address,
    breach_terms. Nulls and blanks are missing; a period with an unknown end isn't judged. Every contract gets the last one.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    tests = [F.col("service_end") <= F.col("service_start"), *(blank(c) for c in ("purchaser_code", "purchaser_address", "supplier_code", "supplier_address", "breach_terms")), F.lit(True)]
    one = [F.when(test, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), F.lit(said).alias("message"))) for test, (code, (level, said)) in zip(tests, FINDINGS.items(), strict=True)]
    return contracts.select(key, F.explode(F.array_compact(F.array(*one))).alias("f")).select(key, "f.*", F.lit(True).alias("requires_human_review"))
