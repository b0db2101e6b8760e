"""Rule executors and checks over relations derived from documents (see ``fixture_queries``), each with SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from . import executors as X
from .driver_queries import ORACLE, QUERIES
from .fixture_queries import derived, values

DOCS = ("seq int, doc string, subtype string, text string", [
    (1, "招标文件.pdf", "招标文件", "项目名称：智慧校园（第2包）\n包编号：A-01\n获取招标文件时间：2026年3月1日至2026年3月8日\n投标截止时间：2026年4月2日9:30\n采购公告发布日期：2026年3月1日\n服务期限为：3 年\n供应商应提供售后承诺。"),
    (2, "评标报告.pdf", "评标报告", "评标情况说明：评审工作有序开展\n开标时间：2026年4月2日9:30\n开标地点：市交易中心 1 厅\n提交投标文件的截止时间：2026-04-02 9:30\n通过资格审查的供应商共 3 家\n符合性审查全部通过\n合同期限为：3年"),
    (3, "开标记录表.xlsx", "开标记录表", "开标时间：2026年4月2日9:30\n开标地点：市交易中心2厅"),
])
NAMES = ("source string, value string", [("系统", "智慧校园"), ("招标文件.pdf", "项目名称：智慧校园第2包"), ("评标报告.pdf", " 智慧 校园。"), ("x", "1. 总则"), ("y", "")])
IDS = ("source string, value string, raw_text string", [("系统", "zc-2026-01", ""), ("招标文件.pdf", "ZC－2026—01", "项目编号：ZC－2026—01"), ("评标报告.pdf", "CG-9", "采购编号：CG-9"), ("公告.pdf", "CG-8", "采购编号：CG-8"), ("公告.pdf", "CG-8 ", "采购编号：CG-8")])
OPENINGS = ("doc string, bidder string, price double", [("评标报告.pdf", "甲公司", 980000.0), ("评标报告.pdf", "乙公司", None), ("开标记录表.xlsx", "甲 公司", 980000.0), ("开标记录表.xlsx", "丙公司", 990000.0), ("开标记录表.xlsx", "", 1.0)])
RANKINGS = ("doc string, lot string, bidder string", [("评标报告.pdf", "", "甲公司"), ("评标报告.pdf", "", "丙 公司"), ("公示.pdf", "", "甲公司"), ("公示.pdf", "", "丙公司"), ("公示.pdf", "", "备注"), ("公示.pdf", "", "乙公司")])
MARKS = ("target string, source_text string, status string", [("投标日期", "年月日", "detected"), ("公章", "盖章处", "detected"), ("评委签字", "签字", "not_checked")])
REJECTED = ("doc string, bidder string, reason string, cited string, evidence string", [("评标报告.pdf", "丁公司", "未提供售后承诺", "", "资格审查不合格"), ("评标报告.pdf", "戊公司", "缺少安全许可证", "第九条", ""), ("评标报告.pdf", "己公司", "", "", "")])
TABLES = ("doc string, table_no int, row_no int, c1 string, c2 string, c3 string, c4 string", [("评标报告.pdf", 1, 1, "序号", "符合性审查", "甲公司", "丙公司"), ("评标报告.pdf", 1, 2, "1", "签字盖章", "通过", "通过"), ("评标报告.pdf", 2, 1, "序号", "资格性审查", "甲公司", "丁公司"), ("评标报告.pdf", 2, 2, "1", "许可证", "通过", "不通过")])
TOTALS = ("bidder string, total double", [("甲公司", 91.2), ("丙公司", 88.0), ("乙公司", None)])
TYPES = ("doc string, file_type string, n_prices int, n_criteria int", [("a", "投标文件", 0, 0), ("b", "投标文件", 2, 0), ("c", "招标文件", 0, 0), ("d", "招标文件", 0, 3), ("e", "合同", 0, 0)])
CITED = ("law string, article string", [("招标投标法", "第三条"), ("招标投标法", "第九百条"), ("某条例", "第一条")])
LAWS = ("law string, article string, words string", [("招标投标法", "第三条", "x"), ("政府采购法", "第一条", "y")])
STATES = ("doc string, code string, status string", [("a", "text", "passed"), ("a", "scan", "warning"), ("b", "text", "failed"), ("b", "scan", "warning"), ("c", "text", "passed")])
PLACES = ("id int, name string, sheet string, page int, row_no int", [(1, "a.pdf", "", 3, None), (2, "b.xlsx", "明细", None, 7), (3, "c.txt", "", None, None)])
PAGES = ("doc string, page int, n_chars int", [("a", 1, 10), ("a", 2, 5), ("a", 3, 20), ("b", 1, 4)])
OFFSETS = ("doc string, offset int", [("a", 0), ("a", 10), ("a", 11), ("a", 16), ("a", 17), ("b", 3), ("b", 99)])
PARTS = ("doc string, seq int, content string", [("a", 2, "two"), ("a", 1, "one"), ("a", 3, ""), ("b", 1, "")])
FIELDS = ("doc string, name string, value string, confidence double", [("a", "budget", "1", 0.7), ("a", "budget", "2", 0.9), ("a", "name", "x", 0.6), ("a", "name", "x", 0.8)])
OLD = ("seq int, title string, content string", [(1, "t", "c"), (2, "u", "d")])
NEW = ("seq int, title string, content string", [(5, "t", "c"), (6, "t", "e"), (7, "t", "e"), (8, "v", "f")])
TASKS = ("task string, modified int", [("a", 5), ("b", 9), ("c", 9), ("d", 1)])
SOURCE = ("id int, doc string, sheet string, row_no int", [(1, "a", "s", 2), (2, "a", "s", 3), (3, "b", "s", 9)])
IDS_A, IDS_B = ("id string", [("a",), ("b",), ("b",)]), ("id string", [("b",), ("c",)])
CELLS = ("doc string, sheet string, row_no int, c1 string, c2 string, c3 string", [("a", "s", 2, "甲", " ", "12"), ("a", "s", 3, "", "乙", "x"), ("b", "s", 1, "n", "n", "n")])


def add(name: str, relations: dict[str, tuple[str, list]], build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: build({k: derived(spark, sf, r) for k, r in relations.items()})
    ORACLE[name] = "WITH " + ", ".join(values(r, k) for k, r in relations.items()) + " " + sql


def tables(r):
    return r["tables"].select("doc", "table_no", "row_no", F.array("c1", "c2", "c3", "c4").alias("cells"))


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def rule(rule_id: str, name: str, relations: dict, build, status: str) -> None:
    """``status``: a SQL expression of one row, null where data are missing."""
    add(f"rule_{rule_id.lower().replace('-', '_')}_{name}", relations, build, f"SELECT '{rule_id}' AS rule_id, coalesce(({status}), 'insufficient_data') AS status")


def any_match(patterns) -> str:
    return " OR ".join(f"regexp_matches(text, {quoted(p)})" for p in patterns)


SAME = "CASE WHEN count(*) >= 2 THEN CASE WHEN count(DISTINCT n) = 1 THEN 'passed' ELSE 'human_review' END END"
FULL = "translate({}, '－—–', '---')"
D = {"docs": DOCS}
rule("P1-01", "lot", D, lambda r: X.stated(r["docs"], "P1-01", X.LOT_PATTERNS, "passed"), f"SELECT CASE WHEN bool_or({any_match(X.LOT_PATTERNS)}) THEN 'passed' END FROM docs")
rule("P1-02", "project_name", {"names": NAMES}, lambda r: X.same_names(r["names"]), rf"SELECT {SAME} FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(value), '^项目名称\s*[:：]?\s*', ''), '\s+', '', 'g'), '{X.LOT_SUFFIX}', ''), '[。；;，,]+$', '') AS n FROM names WHERE trim(value) <> '') WHERE n <> '' AND NOT regexp_matches(n, '^\d+[.、]')")
rule("P1-03", "project_id", {"ids": IDS}, lambda r: X.same_ids(r["ids"]), f"SELECT CASE WHEN sum(c) >= 2 THEN CASE WHEN max(d) = 1 THEN 'passed' ELSE 'human_review' END END FROM (SELECT kind, count(*) AS c, count(DISTINCT n) AS d FROM (SELECT DISTINCT {FULL.format('upper(trim(value))')} AS n, source, CASE WHEN contains(raw_text, '采购编号') THEN 'p' ELSE 'o' END AS kind FROM ids) GROUP BY 1)")
rule("P1-05", "candidate_count", {"rankings": RANKINGS}, lambda r: X.candidate_count(r["rankings"]), "SELECT CASE WHEN count(*) >= 2 THEN CASE WHEN count(DISTINCT n) = 1 THEN 'passed' ELSE 'human_review' END END FROM (SELECT doc, count(DISTINCT lot || replace(bidder, ' ', '')) AS n FROM rankings WHERE bidder LIKE '%公司' GROUP BY 1)")
rule("P1-05", "candidate_count_given", {"rankings": RANKINGS}, lambda r: X.candidate_count(r["rankings"].filter("doc = '评标报告.pdf'"), 2), "SELECT CASE WHEN count(DISTINCT bidder) = 2 THEN 'passed' ELSE 'human_review' END FROM rankings WHERE doc = '评标报告.pdf'")
rule("P1-08", "narrative", D, lambda r: X.stated(r["docs"], "P1-08", (X.NARRATIVE_PATTERN,), "passed"), f"SELECT CASE WHEN bool_or({any_match([X.NARRATIVE_PATTERN])}) THEN 'passed' END FROM docs")
for _id in ("P1-07", "P3-14", "P3-18"):
    rule(_id, "review_price", {"openings": OPENINGS}, lambda r, i=_id: X.review_prices(r["openings"], i), "SELECT CASE WHEN count(*) > 0 THEN 'human_review' END FROM openings WHERE bidder <> '' AND price IS NOT NULL")
for _id, _word in (("P1-10", "日期"), ("P1-11", ""), ("P1-12", "谈判")):
    rule(_id, "marks", {"marks": MARKS, "docs": DOCS}, lambda r, i=_id: X.expected_marks(r["marks"], r["docs"], i), f"SELECT CASE WHEN count(*) > 0 AND bool_and(status = 'detected') THEN 'passed' WHEN count(*) > 0 OR (SELECT count(*) FROM docs WHERE subtype = '评标报告') > 0 THEN 'human_review' END FROM marks WHERE contains(target || source_text, '{_word}')")
rule("P2-01", "sale_dates", D, lambda r: X.stated(r["docs"], "P2-01", X.SALE_PATTERNS, "human_review"), f"SELECT CASE WHEN bool_or({any_match(X.SALE_PATTERNS)}) THEN 'human_review' END FROM docs")
_of = lambda kind, p: rf"(SELECT min(regexp_replace(regexp_extract(text, {quoted(p)}, 1), '\s+', '', 'g')) FROM docs WHERE subtype = '{kind}')"
_time, _place = X.DATE_PATTERNS["P2-08"][0], X.DATE_PATTERNS["P2-07"][0]
rule("P2-02", "opening_meeting", D, lambda r: X.opening_meeting(r["docs"]), f"SELECT CASE WHEN {_of(X.REPORT, _time)} = {_of(X.OPENING, _time)} AND {_of(X.REPORT, _place)} = {_of(X.OPENING, _place)} THEN 'passed' ELSE 'human_review' END")
rule("P2-03", "bidders", {"openings": OPENINGS, "docs": DOCS}, lambda r: X.bidder_sets(r["openings"], r["docs"]), "SELECT CASE WHEN count(DISTINCT subtype) = 2 THEN 'human_review' END FROM openings JOIN docs USING (doc) WHERE bidder <> '' AND subtype IN ('评标报告', '开标记录表')")
_key = rf"list_transform(regexp_extract_all(regexp_extract(v, {quoted(X.DATE_KEY)}, 0), '\d+'), lambda x: CAST(x AS INTEGER))"
for _id in ("P2-04", "P2-05", "P2-08"):
    _v = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {quoted(p)}, 1), '')" for p in X.DATE_PATTERNS[_id]) + ")"
    rule(_id, "date", D, lambda r, i=_id: X.stated_date(r["docs"], i), f"SELECT CASE WHEN count(k) >= 2 THEN CASE WHEN count(DISTINCT k) = 1 THEN 'passed' ELSE 'human_review' END WHEN count(v) > 0 THEN 'human_review' END FROM (SELECT v, {_key} AS k FROM (SELECT doc, arg_min(v, seq) AS v FROM (SELECT doc, seq, {_v} AS v FROM docs) WHERE v IS NOT NULL GROUP BY doc))")
rule("P2-06", "duration", D, lambda r: X.durations(r["docs"]), rf"SELECT CASE WHEN count(DISTINCT t) = 1 THEN 'passed' WHEN count(DISTINCT t) > 1 THEN 'human_review' END FROM (SELECT regexp_extract(regexp_replace(x, '\s+', '', 'g'), {quoted(X.TERM)}, 0) AS t FROM (SELECT unnest(regexp_extract_all(text, {quoted(X.TERM_PATTERNS[0])}, 1)) AS x FROM docs)) WHERE t <> ''")
rule("P2-07", "place", D, lambda r: X.stated_date(r["docs"], "P2-07"), f"SELECT CASE WHEN bool_or({any_match(X.DATE_PATTERNS['P2-07'])}) THEN 'passed' END FROM docs")
for _id, _label, _word in (("P3-01", "资格审查", "资格性审查"), ("P3-03", "符合性审查", "符合性审查")):
    rule(_id, "passed_counts", {"docs": DOCS, "openings": OPENINGS, "tables": TABLES}, lambda r, i=_id: X.passed_counts(r["docs"], r["openings"], tables(r), i), rf"SELECT CASE WHEN bool_or(regexp_matches(text, '通过{_label}[^\n\d]{{0,12}}\d+\s*家') OR regexp_matches(text, '{_label}[^\n。；]{{0,30}}(全部|均)(通过|合格)')) THEN 'passed' END FROM docs")
for _id, _label in (("P3-02", "资格"), ("P3-04", "符合性")):
    rule(_id, "rejections", {"docs": DOCS, "rejections": REJECTED, "tables": TABLES}, lambda r, i=_id: X.rejections(r["docs"], r["rejections"], tables(r), i), rf"SELECT CASE WHEN (SELECT count(*) FROM rejections WHERE contains(reason || ' ' || cited || ' ' || evidence, '{_label}')) > 0 THEN 'human_review' WHEN bool_or(regexp_matches(text, '{_label}(性)?审查[^\n。；]{{0,30}}(全部|均)(通过|合格)')) THEN 'passed' END FROM docs")
rule("P3-07", "score_gap", {"summaries": TOTALS}, lambda r: X.score_gap(r["summaries"]), "SELECT CASE WHEN count(total) >= 2 THEN 'human_review' END FROM summaries")

ALL = {"docs": DOCS, "names": NAMES, "ids": IDS, "openings": OPENINGS, "rankings": RANKINGS, "marks": MARKS, "rejections": REJECTED, "tables": TABLES, "summaries": TOTALS}


def _matrix(r):
    from . import rules

    out = rules.matrix(r["docs"].sparkSession, X.execute(r | {"tables": tables(r)}))
    return out.groupBy("status").agg(F.count("*").alias("n"))


def _matrix_sql() -> str:
    """The catalogue with the status that each rule's own SQL gives."""
    own = {}
    for name, sql in ORACLE.items():
        if name.startswith("rule_") and not name.endswith("_given"):
            own.setdefault(name[5:10].upper().replace("_", "-"), sql)
    catalogue = ", ".join(f"('{r[0]}', {str(r[5]).lower()})" for r in K.RULES)
    return f"""SELECT CASE WHEN NOT active THEN 'disabled' ELSE coalesce(done.status, 'insufficient_data') END AS status, count(*) AS n
FROM (VALUES {catalogue}) c(rule_id, active) LEFT JOIN ({" UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in own.values())}) done USING (rule_id) GROUP BY 1"""


ORACLE["rul_01_matrix"] = _matrix_sql()  # before the rules that the matrix doesn't run are added
QUERIES["rul_01_matrix"] = lambda spark, sf: _matrix({k: derived(spark, sf, r) for k, r in ALL.items()})

add("joi_17_id_sets", {"a": IDS_A, "b": IDS_B}, lambda r: X.id_difference(r["a"], r["b"], "id"), "SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'b' ELSE 'a' END AS only_in FROM (SELECT DISTINCT id FROM a) x FULL JOIN (SELECT DISTINCT id FROM b) y ON x.id = y.id WHERE x.id IS NULL OR y.id IS NULL")
add("set_07_bidder_difference", {"openings": OPENINGS, "docs": DOCS}, lambda r: X.bidder_difference(r["openings"], r["docs"]), "SELECT replace(bidder, ' ', '') AS bidder, min(subtype) AS only_in FROM openings JOIN docs USING (doc) WHERE bidder <> '' GROUP BY 1 HAVING count(DISTINCT subtype) = 1")
add("chk_02_03_missing_inputs", {"types": TYPES}, lambda r: X.missing_inputs(r["types"]), "SELECT doc, '投标报价未识别' AS issue_type, '中' AS risk_level FROM types WHERE contains(file_type, '投标') AND n_prices = 0 UNION ALL SELECT doc, '评分标准未识别', '低' FROM types WHERE contains(file_type, '招标') AND n_criteria = 0")
add("chk_13_rejection_basis", {"rejections": REJECTED, "docs": DOCS}, lambda r: X.unsupported_rejections(r["rejections"], r["docs"].filter("subtype = '招标文件'").select("text"), F.array(F.substring("reason", 4, 4))), "SELECT doc, bidder, 'not found' AS why FROM rejections x WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.subtype = '招标文件' AND ((x.cited <> '' AND contains(d.text, x.cited)) OR contains(d.text, substr(x.reason, 4, 4))))")
add("chk_14_legal_citation", {"cited": CITED, "laws": LAWS}, lambda r: X.unknown_citations(r["cited"], r["laws"]), "SELECT law, article FROM cited WHERE (law, article) NOT IN (SELECT (law, article) FROM laws)")
add("qlt_03_parse_status", {"states": STATES}, lambda r: X.parse_status(r["states"]), "SELECT doc, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'success' END AS status FROM states GROUP BY 1")
add("prj_04_project_name", {"names": NAMES}, lambda r: r["names"].select("source", X.project_name("value").alias("name")), rf"SELECT source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(value), '^项目名称\s*[:：]?\s*', ''), '\s+', '', 'g'), '{X.LOT_SUFFIX}', ''), '[。；;，,]+$', '') AS name FROM names")
add("prj_05_project_id", {"ids": IDS}, lambda r: r["ids"].select("source", X.project_id("value").alias("id")), f"SELECT source, {FULL.format('upper(trim(value))')} AS id FROM ids")
add("prj_10_page_for_offset", {"offsets": OFFSETS, "pages": PAGES}, lambda r: X.page_for_offset(r["offsets"], r["pages"]), "SELECT doc, \"offset\", min(page) AS page FROM offsets JOIN (SELECT doc, page, sum(n_chars + 1) OVER (PARTITION BY doc ORDER BY page) AS stop FROM pages) USING (doc) WHERE \"offset\" < stop GROUP BY 1, 2")
add("prj_12_document_text", {"parts": PARTS}, lambda r: X.document_text(r["parts"]), "SELECT doc, coalesce(string_agg(content, chr(10) ORDER BY seq) FILTER (WHERE content <> ''), '') AS text FROM parts GROUP BY 1")
add("prj_13_source_label", {"places": PLACES}, lambda r: r["places"].select("id", X.source_label("name", "sheet", "page", "row_no").alias("label")), "SELECT id, concat_ws(' / ', name, CASE WHEN sheet <> '' THEN '工作表 ' || sheet END, '第' || page || '页', '第' || row_no || '行') AS label FROM places")
add("prj_18_project_id_kind", {"ids": IDS}, lambda r: r["ids"].select("source", X.project_id_kind(F.concat_ws(" ", "raw_text", "source")).alias("kind")), "SELECT source, CASE WHEN contains(raw_text, '采购编号') THEN 'procurement_id' ELSE 'project_id' END AS kind FROM ids")
add("agg_11_confidence_merge", {"fields": FIELDS}, lambda r: X.merge_fields(r["fields"]), "SELECT doc, name, arg_max(value, confidence) AS value, max(confidence) AS confidence, count(DISTINCT value) > 1 AS review FROM fields GROUP BY 1, 2")
add("set_11_merge_sections", {"old": OLD, "new": NEW}, lambda r: X.merge_new(r["old"], r["new"], ["title", "content"]), "SELECT * FROM old UNION ALL SELECT min(seq), title, content FROM new WHERE (title, content) NOT IN (SELECT (title, content) FROM old) GROUP BY title, content")
add("srt_06_recent_tasks", {"tasks": TASKS}, lambda r: X.recent(r["tasks"], 3), "SELECT * FROM tasks ORDER BY modified DESC, task LIMIT 3")
add("joi_16_evidence_rows", {"records": SOURCE, "cells": CELLS}, lambda r: X.evidence_rows(r["records"], r["cells"].select("doc", "sheet", "row_no", F.array("c1", "c2", "c3").alias("cells"))), "SELECT id, doc, sheet, row_no, concat_ws(' | ', nullif(trim(c1), ''), nullif(trim(c2), ''), nullif(trim(c3), '')) AS evidence FROM records JOIN cells USING (doc, sheet, row_no)")

# Operators of text and of the life of findings.
SCORED = ("lot string, bidder string, factor string, expert string, raw_score double, weight double, weighted_score double", [
    ("", "甲公司", "技术方案", "专家A", 36.0, 50.0, 18.0), ("", "甲公司", "技术方案", "专家B", 35.0, 50.0, 17.5), ("", "甲公司", "技术方案", "专家C", 12.0, 50.0, 9.0),
    ("", "乙公司", "价格", "专家A", 30.0, 50.0, 15.0), ("", "乙公司", "商务", "专家A", 15.0, None, None), ("", "乙公司", "商务", "专家D", 17.0, None, None),
])
SUMS = ("lot string, bidder string, total_score double", [("", "甲公司", 14.83), ("", "乙公司", 31.0)])
BIDS = ("lot string, bidder string, bid_price double", [("包1", "甲公司", 980000.0), ("包1", "乙公司", 990000.0), ("包1", "丙公司", 1000000.0), ("包2", "", 5.0), ("包2", "丁公司", None)])
RANKS = ("bidder string, rank int", [("乙公司", 1), ("甲公司", 2), ("丙公司", None)])
LINES = ("id int, text string", [(1, "联系电话：13800138000，传真 010-66668888。"), (2, "项目名称：智慧校园建设  二期"), (3, "工程名称: 桥梁"), (4, "未提供售后服务承诺，缺少安全许可"), (5, ""), (6, None)])
TWO = ("id int, subtype string, text string", [(1, "业务文件", "响应文件 供应商：甲公司"), (2, "合同", "响应文件 供应商：甲公司"), (3, "其他资料", "响应文件"), (4, "其他资料", "响应 文件\n投标人:乙")])
FINDINGS = ("seq int, owner string, source_file string, source_location string, issue_type string, description string, risk_level string, requires_human_review boolean, quote string", [
    (1, "a", "f", "l", "t", "d", "高", True, "q"), (2, "a", "f", "l", "t", "d", "高", True, "q"), (3, "a", "f", "l", "u", "d", "高", False, "q"), (4, "a", "f", "l", "v", "d", "中", True, "zz"), (5, "a", "f", "l", "w", " ", "中", True, "q"), (6, "a", "g", "l", "w", "d", "低", False, "a b"),
])
FILE_TEXTS = ("source_file string, text string", [("f", "some q here"), ("g", "no such words")])
BONDS = ("id int, statement string, bond string, budget string", [(1, "投标保证金过高", "2万元", "100万元"), (2, "投标保证金过高", "3万元", "100万元"), (3, "其他", "1万元", "100万元"), (4, "投标保证金过高", "", "100万元")])
SAID = ("id int, statement string, a string, b string", [(1, "两处不一致", "A 1", "a1"), (2, "两处不一致", "x", "y"), (3, "两处不一致", "", "")])
PAIRS = ("id int, a string, b string", [(1, "abcd", "abcd"), (2, "abcd", "bcde"), (3, "", ""), (4, "x", None)])
DECIDED = ("seq int, issue_id string, decision string, corrected_text string", [(1, "I1", "正确", ""), (2, "I1", "误判", ""), (3, None, "漏判", "m")])
OPEN = ("issue_id string, risk_level string, requires_human_review boolean", [("I1", "高", False), ("I2", "低", True), ("I3", "低", False)])


def findings(r):
    return r["findings"].withColumn("evidence", F.array("quote"))


def _queries() -> None:
    from ..operators import links, text
    from . import lifecycle, rules

    def scored(rule_id: str, name: str, build, status: str, **relations) -> None:
        rule(rule_id, name, relations or {"scored": SCORED}, build, status)

    scored("P3-08", "price_weights", lambda r: rules.weighted_scores(r["scored"], "P3-08", "价格"), "SELECT CASE WHEN count(*) > 0 THEN CASE WHEN bool_or(abs(raw_score * weight / 100 - weighted_score) > 0.01) THEN 'human_review' ELSE 'passed' END END FROM scored WHERE contains(factor, '价格') AND weight IS NOT NULL")
    scored("P3-10", "technical_weights", lambda r: rules.weighted_scores(r["scored"], "P3-10", "技术"), "SELECT CASE WHEN count(*) > 0 THEN CASE WHEN bool_or(abs(raw_score * weight / 100 - weighted_score) > 0.01) THEN 'human_review' ELSE 'passed' END END FROM scored WHERE contains(factor, '技术') AND weight IS NOT NULL")
    scored("P3-13", "totals", lambda r: rules.totals(r["scored"], r["sums"]), "SELECT CASE WHEN count(*) > 0 THEN CASE WHEN bool_or(abs(c - total_score) > 0.01) THEN 'human_review' ELSE 'passed' END END FROM sums JOIN (SELECT lot, bidder, round(sum(m), 2) AS c FROM (SELECT lot, bidder, factor, avg(coalesce(weighted_score, raw_score)) AS m FROM scored GROUP BY ALL) GROUP BY ALL) USING (lot, bidder)", scored=SCORED, sums=SUMS)
    scored("P2-09", "price_records", lambda r: rules.price_records(r["bids"]), "SELECT CASE WHEN count(*) > 0 THEN CASE WHEN bool_or(bidder = '' OR bid_price IS NULL) THEN 'human_review' ELSE 'passed' END END FROM bids", bids=BIDS)
    scored("P2-11", "committee", lambda r: rules.committee(r["scored"], "公开招标"), "SELECT CASE WHEN count(DISTINCT expert) > 0 THEN CASE WHEN count(DISTINCT expert) < 5 OR count(DISTINCT expert) % 2 = 0 THEN 'human_review' ELSE 'passed' END END FROM scored")
    scored("P1-04", "candidate_ranks", lambda r: rules.candidate_ranks(r["ranks"], r["sums"]), "SELECT CASE WHEN count(*) > 0 THEN CASE WHEN bool_or(rank <> e) THEN 'human_review' ELSE 'passed' END END FROM ranks JOIN (SELECT bidder, row_number() OVER (ORDER BY total_score DESC, bidder) AS e FROM sums) USING (bidder) WHERE rank IS NOT NULL", ranks=RANKS, sums=SUMS)
    add("p1_09_report_sections", {"docs": DOCS}, lambda r: rules.report_sections(r["docs"]).select("seq", F.explode("missing").alias("missing")), "SELECT seq, missing FROM (" + " UNION ALL ".join("SELECT seq, '" + name + "' AS missing FROM docs WHERE NOT (" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")" for name, words in rules.K.REPORT_SECTIONS) + ")")
    add("ext_14b_phones", {"lines": LINES}, lambda r: r["lines"].select("id", F.explode(text.phones("text")).alias("phone")), r"SELECT DISTINCT id, unnest(regexp_extract_all(text, '1[3-9]\d{9}')) AS phone FROM lines")
    add("ext_21_guess_project_name", {"lines": LINES}, lambda r: r["lines"].select("id", text.guess_project_name(F.coalesce("text", F.lit("")), "?").alias("name")), r"SELECT id, CASE WHEN regexp_matches(text, '(项目|工程)名称[:：]') THEN trim(regexp_extract(text, '(?:项目|工程)名称[:：]\s*([^\n\r]+)', 1)) ELSE '?' END AS name FROM lines")
    add("ext_22_first_match", {"lines": LINES}, lambda r: r["lines"].select("id", text.first_match("text", (r"项目名称：(\S+)", r"工程名称:\s*(\S+)")).alias("value")), r"SELECT id, coalesce(nullif(regexp_extract(text, '项目名称：(\S+)', 1), ''), nullif(regexp_extract(text, '工程名称:\s*(\S+)', 1), '')) AS value FROM lines")
    add("flt_04_subtype_from_content", {"two": TWO}, lambda r: r["two"].select("id", text.subtype_from_content("subtype", "text").alias("subtype")), "SELECT id, CASE WHEN subtype IN ('业务文件', '其他资料') AND contains(replace(text, ' ', ''), '响应文件') AND contains(text, '供应商：') THEN '响应文件' ELSE subtype END AS subtype FROM two")
    add("flt_13_is_non_issue", {"said": SAID}, lambda r: r["said"].select("id", text.is_non_issue("statement", "a", "b").alias("none")), "SELECT id, replace(lower(a), ' ', '') <> '' AND replace(lower(a), ' ', '') = replace(lower(b), ' ', '') AS none FROM said")
    add("flt_15b_bond_is_covered", {"bonds": BONDS}, lambda r: r["bonds"].select("id", text.bond_is_covered("statement", "bond", "budget").alias("covered")), "SELECT id, contains(statement, '投标保证金') AND coalesce(TRY_CAST(replace(bond, '万元', '') AS DOUBLE) <= 0.02 * TRY_CAST(replace(budget, '万元', '') AS DOUBLE), FALSE) AS covered FROM bonds")
    add("flt_14b_verbatim", {"findings": FINDINGS, "texts": FILE_TEXTS}, lambda r: lifecycle.verbatim(findings(r), r["texts"], "source_file", "text", "evidence").select("seq"), "SELECT seq FROM findings JOIN texts USING (source_file) WHERE contains(text, quote)")
    add("lif_02b_review_reasons", {"findings": FINDINGS, "texts": FILE_TEXTS}, lambda r: lifecycle.review_reasons(findings(r), r["texts"]).select("seq", "reason"), "SELECT seq, CASE WHEN n > 1 THEN 'duplicate' WHEN trim(description) = '' THEN 'blank' WHEN risk_level = '高' AND NOT requires_human_review THEN 'unflagged' WHEN NOT contains(text, quote) THEN 'unlocated' ELSE '' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY source_file, source_location, issue_type, quote ORDER BY seq) AS n FROM findings) JOIN (SELECT DISTINCT source_file, text FROM texts) USING (source_file)")
    add("lif_03b_issue_ids", {"findings": FINDINGS}, lambda r: lifecycle.with_issue_id(findings(r)).select("seq", "issue_id"), "SELECT seq, 'I' || substr(sha256(concat_ws('|', owner, source_file, source_location, issue_type, description, quote)), 1, 12) AS issue_id FROM findings")
    add("lif_08_review_progress", {"open": OPEN, "decided": DECIDED}, lambda r: lifecycle.review_progress(r["open"], r["decided"]), "SELECT count(*) AS total, count(*) FILTER (WHERE issue_id IN (SELECT issue_id FROM decided WHERE issue_id IS NOT NULL)) AS reviewed, count(*) FILTER (WHERE issue_id NOT IN (SELECT issue_id FROM decided WHERE issue_id IS NOT NULL)) AS remaining FROM open WHERE risk_level = '高' OR requires_human_review")
    add("ano_07b_sequence_ratio", {"pairs": PAIRS}, lambda r: links.sequence_ratio(r["pairs"], "a", "b").select("id", "ratio"), "SELECT id, CAST(CASE id % 4 WHEN 1 THEN 0.75 WHEN 3 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS ratio FROM pairs")


_queries()
