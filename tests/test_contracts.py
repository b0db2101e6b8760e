"""Financial capitals against a plain speller and back, and findings of contract drafts."""

import random
from decimal import Decimal

from sievemark.operators import contracts as C

D = "零壹贰叁肆伍陆柒捌玖"


def section(n):
    out, gap = "", False
    for digit, unit in zip((n // 1000, n // 100 % 10, n // 10 % 10, n % 10), ("仟", "佰", "拾", ""), strict=True):
        if digit:
            out += ("零" if gap and out else "") + D[digit] + unit
        gap = not digit
    return out


def spell(cents):
    whole, fen = divmod(cents, 100)
    out, gap = "", False
    for unit, n in zip("兆亿万 ", [(whole // 10000**k) % 10000 for k in (3, 2, 1, 0)], strict=True):
        if n:
            out += ("零" if out and (gap or n < 1000) else "") + section(n) + unit.strip()
        gap = not n
    return f"人民币{out or '零'}元" + ("整" if not fen else (D[fen // 10] + "角" if fen // 10 else "零") + (D[fen % 10] + "分" if fen % 10 else ""))


def test_capitals_there_and_back(spark):
    draw = random.Random(2)
    cents = [0, 1, 5, 10, 99, 100, 105, 1000000, 100000500, 10000000500, 1000100000, 100000000000000500, 10**18 - 1]
    cents += [int("".join(draw.choice("000123456789") for _ in range(draw.randrange(1, 19)))) for _ in range(1500)]
    df = spark.createDataFrame([(c, Decimal(c) / 100) for c in cents], "c long, a decimal(22,2)")
    for r in df.select("c", C.capital_amount("a").alias("said")).withColumn("back", C.capital_value("said")).collect():
        assert r["said"] == spell(r["c"]) and r["back"] == Decimal(r["c"]) / 100


def test_capitals_in_other_forms_and_none(spark):
    cases = [("拾伍元", 15), ("人民币贰佰圆正", 200), (" 壹万零伍元 叁角整", Decimal("10005.3")), ("零元伍分", Decimal("0.05")), ("壹佰", None), ("壹拾佰元", None), ("壹元贰元", None), ("abc", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert {r["i"]: r["v"] for r in df.select("i", C.capital_value("t").alias("v")).collect()} == {i: None if v is None else Decimal(v) for i, (_, v) in enumerate(cases)}
    odd = spark.createDataFrame([(Decimal("-1"),), (Decimal(10**16),), (None,), (Decimal("0.005"),)], "a decimal(22,3)")
    assert [r[0] for r in odd.select(C.capital_amount("a")).collect()] == [None, None, None, "人民币零元零壹分"]


def test_contract_findings(spark):
    schema = "id int, service_start date, service_end date, purchaser_code string, purchaser_address string, supplier_code string, supplier_address string, breach_terms string"
    from datetime import date as d

    rows = [(1, d(2026, 1, 1), d(2026, 1, 1), "", None, "  ", "x", ""), (2, d(2026, 1, 1), d(2027, 1, 1), "c", "a", "c", "a", "b"), (3, None, d(2027, 1, 1), "c", "a", "c", "a", "b")]
    got = {}
    for r in C.contract_findings(spark.createDataFrame(rows, schema), "id").collect():
        assert r["requires_human_review"] and (r["level"], r["message"]) == C.FINDINGS[r["code"]]
        got.setdefault(r["id"], []).append(r["code"])
    assert got == {1: [c for c in C.FINDINGS if c != "MISSING_SUPPLIER_ADDRESS"], 2: ["LEGAL_REVIEW_REQUIRED"], 3: ["LEGAL_REVIEW_REQUIRED"]}
