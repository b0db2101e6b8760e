"""The quality gate, covers, letters, marks and reports on small relations."""

import pytest
from pyspark.sql import functions as F

from sievemark import constants as K
from sievemark.operators import gate as G
from sievemark.plans import reports as R

DOCS = "doc string, text string, file_type string, is_scanned boolean, ocr_applied boolean, ocr_confidence double"
FIELDS = "doc string, name string, confidence double, requires_human_review boolean"


def test_quality_checks_and_issues(spark):
    docs = spark.createDataFrame([("a", "正文" * 30, "招标文件", False, False, 0.0), ("b", None, "评标报告", True, True, 0.9), ("c", "x" + "�" * 9, "法规依据", True, True, 0.7), ("d", "y", "业务文件", True, None, None)], DOCS)
    fields = spark.createDataFrame([("a", "project_name", 0.9, True), ("a", "budget", 0.7, False), ("b", "project_name", 0.5, False), ("b", "project_name", 0.8, False), ("d", "other", 0.9, False)], FIELDS)
    checks = G.quality_checks(docs, fields)
    got = {(r["doc"], r["code"]): (r["status"], r["message"]) for r in checks.collect()}
    assert len(got) == 16
    assert got["a", "key_fields"] == ("warning", "未识别字段: price_limit；低置信度字段: budget；存在冲突或需确认的字段: project_name")
    assert got["b", "text_extracted"] == ("failed", "未提取到有效文本") and got["b", "scan_detection"] == ("passed", "扫描件已完成 OCR，平均置信度 0.90")
    assert got["b", "key_fields"][0] == "passed" and got["c", "key_fields"] == ("passed", "关键字段检查通过或当前文档类型不要求检查")
    assert got["c", "scan_detection"] == ("warning", "扫描件已完成 OCR，平均置信度 0.70") and got["c", "encoding_quality"][0] == "warning"
    assert got["d", "scan_detection"] == ("warning", "疑似扫描件，需要 OCR 或人工复核") and got["d", "key_fields"][1] == "未识别字段: project_name"
    more = checks.unionByName(spark.createDataFrame([("a", "visual_detection", "warning", "m", True), ("a", "new", "warning", "n", True)], checks.schema))
    issues = {(r["doc"], r["source_location"]): (r["issue_type"], r["risk_level"], r["confidence"]) for r in G.quality_issues(more).collect()}
    assert issues["b", "质量检查/text_extracted"] == ("正文提取异常", "中", 0.35) and issues["a", "质量检查/new"] == ("文档解析质量", "低", 0.55)
    assert ("a", "质量检查/visual_detection") not in issues and len(issues) == 7
    titles = spark.createDataFrame([("a", "一、总则"), ("b", "一、总则"), ("c", "文档正文"), ("d", "x")], "doc string, title string")
    assert {r["doc"]: r["needed"] for r in G.needs_enhancement(docs, fields, titles).collect()} == {"a": True, "b": False, "c": True, "d": True}
    assert G.quality_checks(docs.limit(0), fields).count() == 0


def test_ocr_confidence(spark):
    pages = spark.createDataFrame([("a", "x", 0.5), ("a", " ", 0.1), ("a", "y", 1.0), ("b", "", 0.9)], "doc string, text string, confidence double")
    assert {r["doc"]: r["confidence"] for r in G.ocr_confidence(pages).collect()} == {"a": 0.75, "b": 0.0}


PRICES = [
    ("硬件报价为人民币100元；软件报价：人民币2万元。\n投标总价为人民币20,100元。", None),
    ("硬件报价为人民币100元；软件报价：人民币2万元。\n投标总价：人民币3万元。", (20100.0, 30000.0)),
    ("预算报价为人民币9元；硬件报价为人民币100元。投标总价为人民币1元。", None),
    ("硬件报价为人民币1,000.50元；硬件报价为人民币1,000.50元；服务报价为人民 5元。投标总价人民币2006元。", (1005.5, 2006.0)),
    ("硬件报价为人民币1元；软件报价为人民币2元。", None),
    (None, None),
]


def test_price_sums(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PRICES)], "doc int, text string")
    got = {r["doc"]: r for r in G.price_sums(df).collect()}
    assert {i: (r["calculated"], r["total"]) for i, r in got.items()} == {i: w for i, (_, w) in enumerate(PRICES) if w}
    assert got[1]["evidence"] == ["硬件报价为人民币100元", "软件报价：人民币2万元", "投标总价：人民币3万元"]


@pytest.mark.parametrize(("text", "name"), [("某市财政局\n智慧 校园建设项目\n采购文件", "智慧校园建设项目"), ("政府采购项目\n数据中心运维服务工程采购\n项目编号：A", "数据中心运维服务工程采购"), ("某大学\n图书馆改造工程\n图书馆改造升级工程项目采购。", "图书馆改造升级工程项目采购"), ("甲改造项目\n乙改造项目", "甲改造项目"), ("\n" * 50 + "甲改造项目", None), ("", None), (None, None)])
def test_cover_names(spark, text, name):
    assert spark.createDataFrame([(text,)], "t string").select(G.cover_project_name("t")).first()[0] == name


def test_letters_and_wrapped_names(spark):
    df = spark.createDataFrame([("致 某市财政局：\n供应商：甲 科技有限公司（盖章）\n投标人：甲科技有限公司，合作方  乙研究院\n供应商：应当为公司",), (None,)], "t string")
    rows = df.select(G.response_entities("t").alias("e"), G.response_tenderer("t").alias("n")).collect()
    assert rows[0]["n"] == "某市财政局" and rows[0]["e"] == ["甲科技有限公司", "乙研究院"] and rows[1]["e"] == [] and rows[1]["n"] is None
    long = "某市智慧城市基础设施建设与运维服务"
    cases = [(long, " 采购项目 ", long + "采购项目"), (long, "一、总则", long), (long, "预算：5", long), ("短名", "采购项目", "短名"), (long + "。", "x", long + "。"), (long, "序号 内容 备注", long), (long, None, long), (long, "x" * 31, long)]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v string, f string, w string").select("w", G.wrapped_project_name(F.col("v"), F.col("f")).alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)


def test_marks_and_visual_checks(spark):
    pages = spark.createDataFrame([("a", 2, "加盖公章：\n加盖公章："), ("a", 1, " 投标人（盖章）：\n评委签字：公章："), ("b", 1, None)], "doc string, page int, text string")
    marks = G.expected_marks(pages)
    got = [(r["target"], r["page"], r["source_text"]) for r in marks.orderBy("place").collect()]
    assert got == [("seal", 1, "投标人（盖章）："), ("seal", 1, "评委签字：公章："), ("signature", 1, "评委签字：公章："), ("seal", 2, "加盖公章：")]
    many = spark.createDataFrame([("c", i, f"公章：{i}") for i in range(130)], "doc string, page int, text string")
    assert [r["page"] for r in G.expected_marks(many).orderBy("place").collect()] == list(range(100))
    found = spark.createDataFrame([("a", "seal", 1, 0.9, 0.9, None), ("a", "seal", 1, 0.9, 0.5, True), ("a", "seal", 7, 0.7, 0.9, True), ("a", "signature", 9, 0.9, 0.1, False)], "doc string, target string, page int, confidence double, ocr_confidence double, matches_entity boolean")
    checks = G.visual_checks(found, marks)
    rows = sorted((r["page"], r["target"], r["status"], r["expected"], r["source_text"]) for r in checks.collect())
    assert rows == [(1, "seal", "detected", True, "投标人（盖章）："), (1, "seal", "low_confidence", True, "投标人（盖章）："), (1, "signature", "not_checked", True, "评委签字：公章："), (2, "seal", "not_detected", True, "加盖公章："), (7, "seal", "low_confidence", False, ""), (9, "signature", "mismatch", False, "")]
    assert G.visual_issues(checks).count() == 5


def test_tables_payloads_and_allowed(spark):
    rows = spark.createDataFrame([([[" a  b ", None], [None, " "], ["\x00x\r\n"]],), (None,)], "r array<array<string>>")
    assert [r[0] for r in rows.select(G.normalize_table("r")).collect()] == [[["a b", ""], ["x"]], None]
    schema = "doc string, seq int, evidence string, issue_type string, note string"
    first, second = spark.createDataFrame([("d", 2, " e ", "t", "one"), ("d", 1, None, "t", "two")], schema), spark.createDataFrame([("d", 0, "e", "t ", "three"), ("d", 0, "f", "t", "four"), ("x", 0, "e", "t", "five")], schema)
    assert sorted(r["note"] for r in G.merge_payloads(first, second).collect()) == ["five", "four", "one", "two"]
    given = spark.createDataFrame([("I1",), ("",), ("I9",), (None,)], "issue_id string")
    assert [r[0] for r in G.allowed_issues(given, spark.createDataFrame([("I1",), ("I1",), ("",)], "issue_id string")).collect()] == ["I1"]


def test_conclusions_and_package(spark):
    issues = spark.createDataFrame([("t", K.DATA, "高", "confirmed_issue", 1), ("t", K.DATA, "中", "human_review", 1), ("u", K.ANOMALY, "低", "human_review", 0), ("w", K.PARSER, "低", "confirmed_issue", 2)], "task string, owner string, risk_level string, final_status string, n_evidence int")
    docs = spark.createDataFrame([("t", 2, "d2", "success", 3), ("t", 1, "d1", "success", None), ("u", 1, "e", "failed", None), ("v", 1, "f", "success", 1), ("w", 1, "g", "success", 1)], "task string, place int, doc string, parse_status string, page_count int")
    said = {(r["task"], r["owner"]): r["conclusion"] for r in R.conclusions(issues, docs).collect()}
    assert len(said) == 24
    assert said["t", K.DATA] == "完成关键字段及相关数据交叉核验；经统一结果复核，形成明确问题1项、待人工复核事项1项。"
    assert said["t", K.PARSER] == "完成2份文档共3页的内容解析，并提取正文、章节、表格及关键业务字段。当前未形成需要输出的文档解析质量问题。"
    assert said["v", K.ANOMALY].startswith("基于当前单份材料暂未") and said["t", K.ANOMALY].startswith("当前材料暂未")
    assert said["v", ""].endswith("亦无待人工复核事项。") and "发现1项待人工复核事项，建议" in said["u", ""] and "形成明确问题1项，未发现" in said["w", ""] and "请优先处置" in said["t", ""]
    assert said["t", K.REVIEWER] == "已统一复核各专项智能体发现，最终确认明确问题1项、待人工复核事项1项。"
    fields = spark.createDataFrame([("d1", "project_name", "甲", 0.9, False), ("d1", "tenderer", "乙", 0.5, False), ("e", "project_name", "", 0.1, True), ("d2", "procurement_agency", "丙", 0.9, False)], "doc string, name string, value string, confidence double, requires_human_review boolean")
    people = spark.createDataFrame([("w",), ("t",)], "task string")
    got = {r["task"]: r for r in R.report_package(issues, docs, fields, people).collect()}
    assert (got["t"]["status"], got["t"]["ready"], got["t"]["project_name"], got["t"]["tenderer"], got["t"]["procurement_agency"]) == ("待复核版", True, "甲", "待人工确认", "")
    assert (got["u"]["ready"], got["u"]["pending"], got["u"]["project_name"]) == (False, 1, "") and got["w"]["status"] == "正式核验版" and got["v"]["total"] == 0


def test_report_titles(spark):
    cases = [("x", "标准化评标报告", "标准化评标报告"), ("整改建议报告", "", "评标核验整改建议报告"), ("x", "简版管理层报告", "x（管理层简版）"), ("x", "详细审查报告", "x（详细版）"), ("x", "", "x")]
    got = spark.createDataFrame(cases, "k string, f string, w string").select("w", R.report_title(F.col("k"), F.col("f")).alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)
