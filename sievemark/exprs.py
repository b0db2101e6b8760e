"""Column expressions shared by the operators: text normalisation, tolerances, numbers and money, issue state.

Patterns over document text start with (?U), so that white space and digits have their Unicode meaning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compact(c: str | Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(col(c), WS, "")


def strip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def clean_text(c: str | Column) -> Column:
    """No NUL or carriage return, runs of blanks and tabs as one blank, lines stripped, one blank line at most, trimmed."""
    text = F.regexp_replace(F.replace(col(c), F.lit("\x00"), F.lit("")), r"\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?m)^ +| +$", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalize_compare(c: str | Column) -> Column:
    """The key under which field values of different files are compared."""
    text = F.lower(F.regexp_replace(col(c), r"(?U)[\s，,。；;:：()（）]", ""))
    return F.replace(F.replace(text, F.lit("人民币"), F.lit("")), F.lit("元整"), F.lit("元"))


def normalize_clause(c: str | Column) -> Column:
    """A clause without its leading number, white space and punctuation."""
    text = F.regexp_replace(col(c), r"(?U)^\s*(?:第?[一二三四五六七八九十百零〇0-9]+[、.．）)])\s*", "")
    return F.regexp_replace(text, r"(?U)[\s，,。；;：:]", "")


def normalized_value(c: str | Column) -> Column:
    return F.lower(compact(c))


def line_number(text: str | Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(col(text), F.lit(1), offset), "\n"))


def lines(text: str | Column) -> Column:
    """Stripped lines that are not blank, in order."""
    return F.filter(F.transform(F.split(col(text), "\n"), strip), lambda x: x != "")


def contains_any(c: str | Column, words: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(c), F.lit(w)) for w in words], F.lit(False))


def count_hits(c: str | Column, words: list[str] | tuple[str, ...]) -> Column:
    """How many of the words occur."""
    return reduce(lambda a, b: a + b, [F.contains(col(c), F.lit(w)).cast("int") for w in words], F.lit(0))


def first_case(rules: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(default) if not isinstance(default, Column) else default
    for test, value in reversed(rules):
        out = F.when(test, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def unique_keep_order(c: str | Column) -> Column:
    """Array without blank values and repetitions, first seen first."""
    return F.array_distinct(F.filter(F.transform(col(c), strip), lambda x: x != ""))


def money_values(c: str | Column, limit: int = 10) -> Column:
    """Amounts in order of the three patterns, then of the text, distinct, at most ``limit``."""
    found = [F.regexp_extract_all(col(c), F.lit(p), F.lit(0)) for p in (r"(?U)\d+(?:\.\d+)?\s*万元", r"(?U)\d+(?:\.\d+)?\s*元", r"(?U)人民币\s*\d+(?:\.\d+)?")]
    return F.slice(unique_keep_order(F.concat(*found)), 1, limit)


def number(c: str | Column) -> Column:
    """The first signed decimal, commas removed; null without one."""
    found = F.regexp_extract(F.replace(col(c), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return found.try_cast("double")


def money_yuan(c: str | Column) -> Column:
    """The first amount with a unit, in yuan; null without one."""
    text = F.regexp_replace(col(c), "[,，]", "")
    amount = F.regexp_extract(text, r"(?U)(\d+(?:\.\d+)?)\s*(亿元|万元|元)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"(?U)(\d+(?:\.\d+)?)\s*(亿元|万元|元)", 2)
    return amount * first_case([(unit == "亿元", 1e8), (unit == "万元", 1e4)], 1.0)


def is_close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within an absolute tolerance or one part in 10**9."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def weight_ratio(weight: str | Column) -> Column:
    """Weights above 1 are percent."""
    return F.when(col(weight) > 1, col(weight) / 100).otherwise(col(weight))


def issue_id(*parts: str | Column, evidence: str | Column) -> Column:
    """'I' and 12 hex digits of the SHA-256 of the parts and each evidence, joined by bars."""
    joined = F.concat_ws("|", *[F.coalesce(col(p), F.lit("")) for p in parts], col(evidence))
    return F.concat(F.lit("I"), F.substring(F.sha2(joined, 256), 1, 12))


def needs_review(flag: Column, detection: Column) -> Column:
    return flag | F.coalesce(detection.isin("not_detected", "not_checked", "low_confidence", "mismatch", "uncertain"), F.lit(False))


def issue_state(flag: Column, detection: Column, final_status: Column) -> Column:
    """(requires_human_review, assessment, final_status) from the flags, whatever assessment a caller gave."""
    status = F.when(final_status == "confirmed", "confirmed_issue").otherwise(final_status)
    review = needs_review(flag, detection)
    return F.struct(
        review.alias("requires_human_review"),
        F.when(review, "待人工判断").when(status == "passed", "未发现问题").otherwise("明确问题").alias("assessment"),
        F.when(review, "human_review").when(status == "passed", "passed").otherwise("confirmed_issue").alias("final_status"),
    )


def canonical_json(c: str | Column) -> Column:
    """JSON text with keys in order and no white space between; null where it is no JSON."""
    return F.to_json(F.try_parse_json(col(c)))
