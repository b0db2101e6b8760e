"""What stands between parsed documents and a review: quality checks, fields that want another reader, marks on pages, names on covers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..exprs import clean_text, col, compact, is_close, strip, unique_keep_order
from .text import garbled, is_heading

# Fields that a kind of file must have, and the confidence below which a value or a reading isn't sure.
REQUIRED = {"招标文件": ("project_name", "budget", "price_limit"), **dict.fromkeys(("投标文件", "评标报告", "合同文件", "业务文件"), ("project_name",))}
SURE = 0.75
# Findings of failed checks: type and advice.
CHECK_ISSUES = {
    "text_extracted": ("正文提取异常", "请检查文件是否损坏、加密或为无文本扫描件，必要时重新上传或执行 OCR。"),
    "scan_detection": ("OCR识别质量", "请对照原文件抽查关键页，并在需要时使用更高质量扫描件重新执行 OCR。"),
    "key_fields": ("关键字段待确认", "请对照原文确认项目名称、预算、最高限价等字段，并处理低置信度或冲突值。"),
    "encoding_quality": ("文本编码异常", "请检查源文件编码和解析结果，修正乱码后重新核验。"),
}
OTHER_CHECK = ("文档解析质量", "请对照原文核对解析结果。")


def ocr_confidence(pages: DataFrame) -> DataFrame:
    """AGG-12: (doc, confidence), the mean over pages (doc, text, confidence) that have text; 0 where none has."""
    return pages.groupBy("doc").agg(F.coalesce(F.avg(F.when(F.trim("text") != "", F.col("confidence"))), F.lit(0.0)).alias("confidence"))


def _field_states(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """docs with ``missing``, ``unsure`` and ``open``: its required fields in those states, in the order of REQUIRED."""
    wanted = reduce(lambda out, x: F.when(F.col("file_type") == x[0], F.array(*map(F.lit, x[1]))).otherwise(out), REQUIRED.items(), F.array().cast("array<string>"))
    names = sorted({n for own in REQUIRED.values() for n in own})
    known = fields.filter(F.col("name").isin(*names)).groupBy("doc", "name").agg(F.max(F.struct("confidence", "requires_human_review")).alias("f"))
    held = known.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("name", "f"))).alias("__held"))  # a few names a document
    rows = docs.join(held, "doc", "left").withColumn("__want", wanted)
    of = lambda n: F.col("__held")[n]
    return rows.withColumns({
        "missing": F.filter("__want", lambda n: of(n).isNull()),
        "unsure": F.filter("__want", lambda n: F.coalesce(of(n)["confidence"] < SURE, F.lit(False))),
        "open": F.filter("__want", lambda n: F.coalesce(of(n)["requires_human_review"], F.lit(False))),
    }).drop("__want", "__held")


def quality_checks(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """QLT-01: (doc, code, status, message, requires_human_review), four rows a document.

    docs: doc, text, file_type, is_scanned, ocr_applied, ocr_confidence. fields: doc, name, confidence,
    requires_human_review; of one name the surest counts. Null text is none; null flags are false.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    text = F.coalesce("text", F.lit(""))
    # The messages of the checks.
    unread = yes("is_scanned") & (~yes("ocr_applied") | (F.coalesce("ocr_confidence", F.lit(0.0)) < SURE))
    scan = F.when(yes("is_scanned") & yes("ocr_applied"), F.format_string("扫描件已完成 OCR，平均置信度 %.2f", F.coalesce("ocr_confidence", F.lit(0.0)))).when(yes("is_scanned"), "疑似扫描件，需要 OCR 或人工复核").otherwise("未发现明显扫描件特征")
    said = F.concat_ws("；", *[F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", "))) for c, label in (("missing", "未识别字段: "), ("unsure", "低置信度字段: "), ("open", "存在冲突或需确认的字段: "))])
    bad = garbled(text)
    one = lambda code, failed, status, message: F.struct(F.lit(code).alias("code"), F.when(failed, status).otherwise("passed").alias("status"), message.alias("message"), failed.alias("requires_human_review"))
    checks = F.array(
        one("text_extracted", text == "", "failed", F.when(text == "", "未提取到有效文本").otherwise("已提取有效文本")),
        one("scan_detection", unread, "warning", scan),
        one("key_fields", said != "", "warning", F.when(said != "", said).otherwise("关键字段检查通过或当前文档类型不要求检查")),
        one("encoding_quality", bad, "warning", F.when(bad, "文本中存在较多乱码替换符").otherwise("未发现明显乱码")),
    )
    return _field_states(docs, fields).select("doc", F.explode(checks).alias("c")).select("doc", "c.*")


def quality_issues(checks: DataFrame) -> DataFrame:
    """QLT-02: findings (doc, issue_type, risk_level, source_location, description, suggestion, confidence) of checks that need a person.

    Checks of what a page shows have findings of their own, so ``visual_detection`` gives none.
    """
    rows = checks.filter(F.col("requires_human_review") & (F.col("code") != "visual_detection"))
    name = lambda i: reduce(lambda out, x: F.when(F.col("code") == x[0], x[1][i]).otherwise(out), CHECK_ISSUES.items(), F.lit(OTHER_CHECK[i]))
    failed = F.col("status") == "failed"
    return rows.select("doc", name(0).alias("issue_type"), F.when(failed, "中").otherwise("低").alias("risk_level"), F.concat(F.lit("质量检查/"), "code").alias("source_location"), F.col("message").alias("description"), name(1).alias("suggestion"), F.when(failed, 0.35).otherwise(0.55).alias("confidence"))


def needs_enhancement(docs: DataFrame, fields: DataFrame, sections: DataFrame) -> DataFrame:
    """FLT-24: (doc, needed): no recognised heading, or a field its kind must have is missing, unsure or open.

    docs: doc, file_type; kinds without fields of their own must have a project's name. sections: doc, title.
    """
    titled = sections.filter(F.col("title") != "文档正文").select("doc").distinct().withColumn("titled", F.lit(True))
    kind = F.when(F.col("file_type") == "招标文件", "招标文件").otherwise("业务文件")
    states = _field_states(docs.select("doc", kind.alias("file_type")), fields)
    lacks = F.size(F.concat("missing", "unsure", "open")) > 0
    return states.join(titled, "doc", "left").select("doc", (F.col("titled").isNull() | lacks).alias("needed"))


# A component's price and the total in a bid's text, and words of prices that are neither.
PART_PRICE = r"([^。；\n]{1,40}?)报价(?:为|：|:)?人民币?\s*([0-9,]+(?:\.[0-9]+)?)\s*(万元|元)"
TOTAL_PRICE = r"投标总价(?:为|：|:)?人民币?\s*([0-9,]+(?:\.[0-9]+)?)\s*(万元|元)"
NOT_A_PART = ("投标总价", "预算", "限价")


def price_sums(docs: DataFrame) -> DataFrame:
    """CHK-10: (doc, calculated, total, evidence) of texts whose distinct component prices, two or more, don't add up to the total.

    docs: doc, text. Amounts are yuan; the first total counts. Texts without a total or with one component say nothing.
    """
    money = lambda amount, unit: F.replace(amount, F.lit(","), F.lit("")).try_cast("double") * F.when(unit == "万元", 10_000.0).otherwise(1.0)
    # each text is matched once: what is found goes through a generator, so that no filter on it is computed from the text again
    once = lambda rows, **made: rows.select("doc", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("x")).select("doc", "x.*")
    rows = once(docs.filter(F.col("text").rlike(TOTAL_PRICE)), found=F.regexp_extract_all("text", F.lit(PART_PRICE), F.lit(0)), last=F.regexp_extract("text", TOTAL_PRICE, 0))
    clauses = F.filter("found", lambda x: ~F.regexp_extract(x, PART_PRICE, 1).rlike("|".join(NOT_A_PART)))
    parts = F.transform(clauses, lambda x: F.struct(strip(x).alias("clause"), money(F.regexp_extract(x, PART_PRICE, 2), F.regexp_extract(x, PART_PRICE, 3)).alias("value")))
    rows = once(rows.filter(F.size("found") >= 2), parts=F.array_distinct(parts), total=money(F.regexp_extract("last", TOTAL_PRICE, 1), F.regexp_extract("last", TOTAL_PRICE, 2)), last=strip("last"))
    rows = rows.filter(F.size("parts") >= 2).withColumn("calculated", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["value"]))
    evidence = F.array_append(F.transform("parts", lambda x: x["clause"]), F.col("last"))
    return rows.filter(~is_close(F.col("calculated"), F.col("total"), 0.01)).select("doc", F.round("calculated", 2).alias("calculated"), "total", evidence.alias("evidence"))


# What a cover's line says where it isn't the project's name, and what it must say to be one.
COVER_CHARS, COVER_LINES = 3000, 50
COVER_LABEL = r"(?:采购人|招标人|代理机构|项目编号|日期|目录|投标人)[:：]"
COVER_NEEDS = ("项目|工程", "采购|招标|建设|服务|维护|运维|改造|升级|评标|工程")
COVER_BARE = r"^[\x{4e00}-\x{9fff}]{0,10}(?:政府)?(?:采购|招标)项目$"
COVER_BODY = r"^[\x{4e00}-\x{9fff}A-Za-z0-9（）()·]+(?:大学|学院|公司|中心|局|委员会)$"


def cover_project_name(text: str | Column) -> Column:
    """EXT-04: the likeliest project name among a cover's first lines: those with 项目 first, then the longest, then the first; null without one."""
    cover = F.slice(F.split(F.left(F.coalesce(col(text), F.lit("")), F.lit(COVER_CHARS)), "\r\n|\r|\n"), 1, COVER_LINES)
    lines = F.transform(cover, lambda x: F.regexp_replace(compact(x), "^[：:。、；;]+|[：:。、；;]+$", ""))
    fits = lambda x: F.length(x).between(4, 100) & ~x.rlike(COVER_LABEL) & x.rlike(COVER_NEEDS[0]) & x.rlike(COVER_NEEDS[1]) & ~x.rlike(COVER_BARE) & ~x.rlike(COVER_BODY)
    rated = F.transform(lines, lambda x, i: F.when(fits(x), F.struct(F.contains(x, F.lit("项目")).alias("p"), F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return F.array_max(F.array_compact(rated))["x"]


# Labels before a supplier's name, marks of an organisation's name, and words that aren't in one.
PARTY = r"(?:合作方|投标人|供应商|受邀方|承诺单位)"
PARTY_PATTERNS = (rf"(?U){PARTY}\s*[:：]\s*([^\n，。；:：]{{2,80}})", rf"(?U){PARTY}\s+：?\s*([^\n，。；:：]{{2,80}})")
ORGANISATIONS = ("公司", "集团", "大学", "学院", "研究院", "研究所", "中心", "事务所", "合作社", "厂", "局", "院", "所")
NO_PARTY = ("应当", "不得", "其他供应商", "采购人", "代理机构", "响应文件")


def response_entities(text: str | Column) -> Column:
    """EXT-05: suppliers that a response names after a label, distinct in order, at most 20."""
    body = F.coalesce(col(text), F.lit(""))
    found = F.concat(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in PARTY_PATTERNS])
    names = F.transform(found, lambda x: F.regexp_replace(compact(x), "^[（）()盖章签字]+|[（）()盖章签字]+$", ""))
    has = lambda x, words: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])
    return F.slice(unique_keep_order(F.filter(names, lambda x: F.length(x).between(2, 50) & has(x, ORGANISATIONS) & ~has(x, NO_PARTY))), 1, 20)


def response_tenderer(text: str | Column) -> Column:
    """EXT-05: whom a response is addressed to, after 致; null without one."""
    return F.nullif(compact(F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?U)(?:^|\n)\s*致\s*([^\n:：]{4,100})\s*[:：]", 1)), F.lit(""))


TABLE_HEAD = r"(?U)^(?:序号|编号)?\s*(?:内容|名称|项目|条款|备注)(?:\s+(?:内容|名称|项目|条款|备注))*$"


def wrapped_project_name(value: Column, following: Column) -> Column:
    """EXT-03: a long name and the short line after it, where that goes on with it."""
    line = strip(following)
    goes_on = (F.length(value) >= 15) & F.length(line).between(1, 30) & ~value.rlike("[。；;：:]$") & ~line.rlike("[:：]") & ~is_heading(line) & ~line.rlike(TABLE_HEAD)
    return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(value, line)).otherwise(value)


# Lines that call for a seal or a signature.
MARKS = {
    "seal": r"(?:投标人|供应商|单位)?[（(]?盖章[）)]?[：:]|加盖公章[：:]|公章[：:]",
    "signature": r"(?:法定代表人|授权代表|评委|专家|签署人)[（(]?(?:签字|签名)[）)]?[：:]",
}
MOST_MARKS, MARK_CHARS = 100, 200
#: Detections below these are unsure: as such, and by a seal's own text.
SURE_MARK, SURE_SEAL = 0.8, 0.6


def expected_marks(pages: DataFrame) -> DataFrame:
    """EXT-17: (doc, place, target, page, source_text) of lines (doc, page, text) that call for a seal or signature, each once, a document's first 100."""
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line", "raw")).withColumn("source_text", F.left(strip("raw"), F.lit(MARK_CHARS)))
    targets = F.array_compact(F.array(*[F.when(strip("raw").rlike(p), F.struct(F.lit(i).alias("i"), F.lit(t).alias("target"))) for i, (t, p) in enumerate(MARKS.items())]))
    rows = lines.withColumn("t", F.explode(targets)).groupBy("doc", F.col("t.target").alias("target"), "page", "source_text").agg(F.min(F.struct("page", "line", "t.i")).alias("at"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("at"))).filter(F.col("place") <= MOST_MARKS).drop("at")


def visual_checks(detections: DataFrame, marks: DataFrame) -> DataFrame:
    """VIS-01 with JOI-13: (doc, target, page, expected, status, source_text, requires_human_review).

    detections: doc, target, page, confidence, ocr_confidence, matches_entity (null where nothing can be compared). marks
    as ``expected_marks`` gives them: a detection meets the first of its target and page, a mark that none meets is
    not_detected (seals) or not_checked (signatures).
    """
    first = marks.groupBy("doc", "target", "page").agg(F.min_by("source_text", "place").alias("source_text"))
    unsure = (F.col("confidence") < SURE_MARK) | ((F.col("target") == "seal") & (F.col("ocr_confidence") < SURE_SEAL))
    status = F.when(~F.coalesce("matches_entity", F.lit(True)), "mismatch").when(unsure, "low_confidence").otherwise("detected")
    keys = ["doc", "target", "page"]
    seen = detections.withColumn("status", status).join(first, keys, "left").select(*keys, F.col("source_text").isNotNull().alias("expected"), "status", F.coalesce("source_text", F.lit("")).alias("source_text"))
    absent = marks.join(detections.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(True).alias("expected"), F.when(F.col("target") == "seal", "not_detected").otherwise("not_checked").alias("status"), "source_text")
    return seen.unionByName(absent).withColumn("requires_human_review", F.col("status") != "detected")


def visual_issues(checks: DataFrame) -> DataFrame:
    """VIS-02: the checks of marks that a person must look at, one for each document, target, page and state."""
    return checks.filter("requires_human_review").groupBy("doc", "target", "page", "status").agg(F.count("*").alias("n"))


def normalize_table(rows: str | Column) -> Column:
    """PRJ-02: cells cleaned, nulls blank, rows without any text dropped."""
    cleaned = F.transform(col(rows), lambda r: F.transform(r, lambda c: clean_text(F.coalesce(c, F.lit("")))))
    return F.filter(cleaned, lambda r: F.exists(r, lambda c: c != ""))


def merge_payloads(first: DataFrame, second: DataFrame) -> DataFrame:
    """SET-10: findings (doc, seq, evidence, issue_type, others) of a first and a repeated reading: of equal evidence and type the first one."""
    rows = first.withColumn("__r", F.lit(0)).unionByName(second.withColumn("__r", F.lit(1)))
    rest = [c for c in first.columns if c != "doc"]
    key = [F.coalesce(strip(c), F.lit("")).alias(f"__{c}") for c in ("evidence", "issue_type")]
    return rows.groupBy("doc", *key).agg(F.min(F.struct("__r", "seq", *[c for c in rest if c != "seq"])).alias("m")).select("doc", *[f"m.{c}" for c in rest])


def allowed_issues(given: DataFrame, issues: DataFrame) -> DataFrame:
    """JOI-15: a report's findings that the review has too, by issue_id; none may be added."""
    return given.join(issues.filter("issue_id <> ''").select("issue_id").distinct(), "issue_id", "left_semi")


