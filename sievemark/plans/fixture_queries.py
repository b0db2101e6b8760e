"""Queries over relations of the domain that are derived from documents, each with SQL over the same derivation.

The tables have no procurement texts, so a document stands for one row of such a relation: its id picks the row's form
from those listed here and is its number, its source is a part of bidders' names, its length a part of prices and totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..exprs import money_yuan
from ..operators import scores, text
from . import lifecycle, rules
from .driver_queries import ORACLE, QUERIES, docs

# Relations: columns and rows. Strings, numbers, booleans and None only, so that they can be written as VALUES.
FILES = ("file_id string, name string, kind string, subtype string", [
    ("f1", "招标文件.pdf", "", ""), ("f2", "甲公司投标文件.docx", "", ""), ("f3", "开标记录表.xlsx", "", ""), ("f4", "专家评分表.xlsx", "", ""), ("f5", "评标报告.pdf", "", ""),
    ("f6", "合同.doc", "", ""), ("f7", "采购法规.txt", "", ""), ("f8", "notes.md", "", ""), ("f9", "photo.png", "", ""), ("f10", "评分汇总.xlsx", "", ""), ("f11", "无效投标说明.pdf", "", ""), ("f12", "报价明细.xlsx", "", ""),
])
CLAUSES = ("id int, line string", [
    (1, "投标人注册地址必须在本市，否则不得参加投标。"), (2, "须提供指定品牌的服务器，其他品牌不得分。"), (3, "方案优秀得 10 分，一般得 5 分。"), (4, "招标人有权调整中标候选人，无需说明理由。"), (5, "供应商注册资本不低于 500 万元。"),
    (6, "不得设置注册资本限制，成立满3年。"), (7, "短"), (8, "本项目注册资本金由项目公司承担，成立满1年。"), (9, "供货产品的技术参数应兼容现有系统。"), (10, "今天天气很好，宜外出。"),
])
# Evidence of returned findings: a part of clause 1, and more than clause 3.
RETURNED = ("evidence string", [("注册地址必须在本市",), ("评分标准：方案优秀得 10 分，一般得 5 分。以上为主观分",), ("",), (None,)])
VALUES = ("id int, field string, value string", [
    (1, "tenderer", "____"), (2, "tenderer", "待填写"), (3, "tenderer", "某市财政局"), (4, "tenderer", "是指依法进行政府采购的单位"), (5, "budget", "120万元"), (6, "budget", "人民币1,200.50元"), (7, "budget", "1.5亿元整"), (8, "budget", "（   ）万元"), (9, "name", "乙（集团）有限公司"), (10, "name", "1. 评分细则公司"), (11, "name", "某大学"), (12, "budget", ""),
])
SCORES = ("doc string, bidder string, lot string, factor string, expert string, max_score double, raw double, weight double, weighted double", [
    ("d", "甲公司", "", "技术方案", "专家A", 40.0, 36.0, 50.0, 18.0), ("d", "甲公司", "", "技术方案", "专家B", 40.0, 35.0, 50.0, 17.5), ("d", "甲公司", "", "技术方案", "专家C", 40.0, 12.0, 50.0, 9.0),
    ("d", "乙公司", "", "技术方案", "专家A", 40.0, 30.0, 50.0, 15.0), ("d", "乙公司", "", "商务", "专家A", 20.0, 15.0, None, None), ("d", "乙公司", "", "商务", "专家B", 20.0, 17.0, None, None),
])
SUMMARIES = ("doc string, bidder string, lot string, total double, rank int", [
    ("d", "甲公司", "", 14.83, 1), ("d", "乙公司", "", 31.0, 2),
])
OPENINGS = ("doc string, bidder string, lot string, price double", [
    ("a", "甲公司", "包1", 980000.0), ("b", "甲公司", "包1", 990000.0), ("a", "乙公司", "包1", 1000000.0), ("a", "丙公司", "包1", 1010000.0), ("a", "丁公司", "包2", 500000.0), ("a", "戊公司", "包2", None),
])
ISSUES = ("seq int, owner string, risk_level string, issue_type string, source_file string, source_location string, description string, quote string, requires_human_review boolean, detection_status string, final_status string, confidence double", [
    (1, K.ANOMALY, "高", K.MERGEABLE_TYPES[0], "a.pdf", "甲、乙", "d1", "q1", True, "", "confirmed", 0.85), (2, K.ANOMALY, "中", K.MERGEABLE_TYPES[1], "b.pdf", "甲、乙", "d2", "q2", True, "", "", 0.7),
    (3, K.DATA, "高", "总分复算不一致", "a.pdf", "甲", "d3", "q1", False, "mismatch", "confirmed", 0.99), (4, K.DATA, "高", "总分复算不一致", "a.pdf", "甲", "d4", "q1", True, "", "", 0.99), (5, K.COMPLIANCE, "低", "x", "a.pdf", "", "d5", "q3", False, "", "passed", 0.5),
])
REVIEWS = ("seq int, issue_id string, decision string, corrected_text string", [
    (1, "I1", "正确", ""), (2, "I2", "误判", ""), (3, "I1", "需修改", "new"), (4, None, "漏判", "missed"),
])


#: Columns that number rows, that name bidders, and that hold amounts.
NUMBERS, BIDDERS, AMOUNTS = ("id", "seq", "file_id"), ("bidder",), ("price", "bid_price", "total", "total_score")
#: Small relations that aren't of documents: what a person hands in.
GIVEN: list[tuple[str, list]] = [RETURNED]


def columns(relation: tuple[str, list]) -> list[list[str]]:
    return [c.split() for c in relation[0].split(", ")]


def frame(spark: SparkSession, relation: tuple[str, list]) -> DataFrame:
    return spark.createDataFrame(relation[1], relation[0])


def derived(spark: SparkSession, sf_dir: str, relation: tuple[str, list]) -> DataFrame:
    """The relation with a row for each document."""
    if relation in GIVEN:
        return frame(spark, relation)
    cols = columns(relation)
    forms = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, cols, strict=True)]) for r in relation[1]])
    rows = docs(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars", F.element_at(forms, (F.pmod("doc_id", F.lit(len(relation[1]))) + 1).cast("int")).alias("f"))

    def column(name: str, kind: str):
        own = F.col(f"f.{name}")
        if name in NUMBERS:
            own = F.concat(F.lit("f"), F.col("doc_id").cast("string")) if kind == "string" else F.col("doc_id").cast(kind)
        elif name in BIDDERS:
            own = F.when(own != "", F.concat("source", own)).otherwise(own)
        elif name in AMOUNTS:
            own = own + F.col("n_chars")
        return own.alias(name)

    return rows.select(*[column(c, t) for c, t in cols])


def values(relation: tuple[str, list], name: str) -> str:
    cols = [c.split() for c in relation[0].split(", ")]
    types = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    lit = lambda v: "NULL" if v is None else ("TRUE" if v is True else "FALSE" if v is False else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'")
    cells = lambda r: ", ".join(f"CAST({lit(v)} AS {types[t]})" for v, (_, t) in zip(r, cols, strict=True))
    names = ", ".join(f'"{c}"' for c, _ in cols)
    if relation in GIVEN:
        return f"{name}({names}) AS (VALUES {', '.join(f'({cells(r)})' for r in relation[1])})"
    forms = ", ".join(f"({i}, {cells(r)})" for i, r in enumerate(relation[1]))

    def column(c: str, t: str) -> str:
        if c in NUMBERS:
            return "'f' || d.doc_id" if t == "string" else f"CAST(d.doc_id AS {types[t]})"
        if c in BIDDERS:
            return f"CASE WHEN f.{c} <> '' THEN coalesce(d.source, '') || f.{c} ELSE f.{c} END"
        return f'f."{c}" + d.n_chars' if c in AMOUNTS else f'f."{c}"'

    own = ", ".join(f'{column(c, t)} AS "{c}"' for c, t in cols)
    return f"{name} AS (SELECT {own} FROM documents d JOIN (VALUES {forms}) f(form, {names}) ON f.form = d.doc_id % {len(relation[1])})"


def add(name: str, relation: tuple[str, list], build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: build(derived(spark, sf, relation))
    ORACLE[name] = f"WITH {values(relation, 't')} {sql}"


def case(column: str, rules_: tuple, default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{v}'" for words, v in rules_) + f" ELSE {default} END"


TYPE_SQL = case("name", K.FILE_TYPES, "CASE WHEN regexp_matches(lower(name), '\\.(pdf|doc|docx|txt|md|xlsx)$') THEN '业务文件' ELSE '未知文件' END")
add("flt_02_infer_file_type", FILES, lambda d: d.select("file_id", text.file_type("name").alias("kind")), f"SELECT file_id, {TYPE_SQL} AS kind FROM t")
add("flt_03_infer_document_subtype", FILES, lambda d: d.select("file_id", text.document_subtype("name", text.file_type("name")).alias("subtype")), f"SELECT file_id, {case('name', K.SUBTYPES, TYPE_SQL)} AS subtype FROM t")
ROLE_SQL = case("lower(name || '  ')", K.ROLES, "'other'")
add("flt_05_classify_document_role", FILES, lambda d: d.select("file_id", text.document_role("name", "kind", "subtype").alias("role")), f"SELECT file_id, {ROLE_SQL} AS role FROM t")
add("agg_08_role_counts", FILES, lambda d: d.groupBy(text.document_role("name", "kind", "subtype").alias("role")).agg(F.count("*").alias("n")), f"SELECT {ROLE_SQL} AS role, count(*) AS n FROM t GROUP BY 1")


def missing_roles(d: DataFrame) -> DataFrame:
    need = d.sparkSession.createDataFrame([(r,) for r in K.CORE_ROLES], "role string")
    return need.join(d.select(text.document_role("name", "kind", "subtype").alias("role")).distinct(), "role", "left_anti")


MISSING_SQL = f"SELECT role FROM (SELECT unnest({list(K.CORE_ROLES)}) AS role) n WHERE role NOT IN (SELECT {ROLE_SQL} FROM t)"
add("joi_07_missing_roles", FILES, missing_roles, MISSING_SQL)
add("inv_01_material_inventory", FILES, missing_roles, MISSING_SQL)

NON_OP_SQL = "(regexp_matches(line, '[【\\[][】\\]]') OR " + " OR ".join(f"contains(line, '{w}')" for w in ("本项目注册资本", "项目公司注册资本", *K.REFERENCE_MARKERS)) + " OR (contains(line, '资金来源') AND contains(line, '注册资本')))"
CATEGORY_SQL = """CASE WHEN length(line) < 8 OR length(line) > 500 THEN ''
 WHEN regexp_matches(line, '注册地址|本市设立|本地企业') AND regexp_matches(line, '必须|不得|得|满') THEN '地域或本地条件'
 WHEN contains(line, '品牌') AND regexp_matches(line, '必须|指定|不接受|不得分|得分') THEN '品牌限制或品牌评分'
 WHEN regexp_matches(line, '丰富|全面深入|优秀|良好|一般|较差') AND regexp_matches(line, '得\\s*\\d+(\\.\\d+)?\\s*分') THEN '主观评分'
 WHEN (regexp_matches(line, '调整|改变') AND regexp_matches(line, '中标候选人|评标结果|评审结果')) OR contains(line, '无需说明理由') THEN '程序权限'
 WHEN regexp_matches(line, '注册资本|成立满|项目业绩') AND regexp_matches(line, '\\d') THEN '资格门槛' ELSE '' END"""
add("flt_11_is_non_operational_clause", CLAUSES, lambda d: d.select("id", text.is_non_operational("line").alias("skip")), f"SELECT id, {NON_OP_SQL} AS skip FROM t")
COVER = lambda d: text.coverage_candidates(d, "id", "line").select(F.col("doc").alias("id"), "category")
add("flt_12_coverage_candidates", CLAUSES, COVER, f"SELECT id, {CATEGORY_SQL} AS category FROM t WHERE {CATEGORY_SQL} <> '' AND NOT {NON_OP_SQL}")
HITS = {g: " + ".join(f"CAST(contains(line, '{w}') AS INTEGER)" for w in words) for g, words in K.CLAUSE_GROUPS}
GROUP_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(line, '{w}')" for w in words) + f" THEN '{g}'" for words, g in K.CLAUSE_OVERRIDES) + f" WHEN greatest({', '.join(HITS.values())}) = 0 THEN 'procedure' " + " ".join(f"WHEN {h} = greatest({', '.join(HITS.values())}) THEN '{g}'" for g, h in HITS.items()) + " END"
add("flt_21_batch_classifier", CLAUSES, lambda d: d.select("id", text.clause_group("line").alias("grp")), f"SELECT id, {GROUP_SQL} AS grp FROM t")


_CLAUSE = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s*(?:第?[一二三四五六七八九十百零〇0-9]+[、.．）)])\\s*', ''), '[\\s，,。；;：:]', '', 'g')"


def coverage_gap(d: DataFrame) -> DataFrame:
    left = text.uncovered(text.coverage_candidates(d, "id", "line"), frame(d.sparkSession, RETURNED))
    return left.select(F.col("doc").alias("id"), "category")


add("chk_15_coverage_gap", CLAUSES, coverage_gap, "")
ORACLE["chk_15_coverage_gap"] = f"""WITH {values(CLAUSES, 't')}, {values(RETURNED, 'returned')}, r AS (SELECT {_CLAUSE('evidence')} AS held FROM returned), c AS (SELECT *, {_CLAUSE('line')} AS own FROM t)
SELECT id, {CATEGORY_SQL} AS category FROM c WHERE {CATEGORY_SQL} <> '' AND NOT {NON_OP_SQL} AND NOT EXISTS (SELECT 1 FROM r WHERE held <> '' AND (contains(own, held) OR contains(held, own)))"""

PLACE_SQL = f"(c = '' OR regexp_matches(c, '^[_＿—\\-/.（）()\\[\\]【】]+(万元|元)?$') OR regexp_matches(c, '[_＿]{{2,}}') OR lower(c) IN ({', '.join(repr(w) for w in K.NULL_WORDS)}))"
COMPACT = "(SELECT *, regexp_replace(value, '\\s+', '', 'g') AS c FROM t)"
add("flt_07_is_placeholder_value", VALUES, lambda d: d.select("id", text.is_placeholder("value").alias("blank")), f"SELECT id, {PLACE_SQL} AS blank FROM {COMPACT}")
add("flt_08_is_definition_value", VALUES, lambda d: d.select("id", text.is_definition("field", "value").alias("definition")), f"SELECT id, field = 'tenderer' AND (starts_with(c, '指') OR starts_with(c, '是指') OR contains(c, '依法进行政府采购') OR contains(c, '受采购人委托')) AS definition FROM {COMPACT}")
add("flt_09_looks_like_bidder_name", VALUES, lambda d: d.select("id", text.looks_like_bidder("value").alias("bidder")), f"SELECT id, c <> '' AND length(c) <= 80 AND NOT regexp_matches(c, '^[（(]?\\d+[）).、]') AND NOT regexp_matches(c, '评标委员会|说明：|说明:|得分|不得分|扫描件') AND regexp_matches(c, '{K.ORGANISATION_END}') AS bidder FROM {COMPACT}")
YUAN_SQL = "CASE WHEN regexp_matches(m, '(\\d+(?:\\.\\d+)?)\\s*(亿元|万元|元)') THEN CAST(regexp_extract(m, '(\\d+(?:\\.\\d+)?)\\s*(亿元|万元|元)', 1) AS DOUBLE) * CASE regexp_extract(m, '(\\d+(?:\\.\\d+)?)\\s*(亿元|万元|元)', 2) WHEN '亿元' THEN 1e8 WHEN '万元' THEN 1e4 ELSE 1.0 END END"
add("flt_15_resolved_by_context", VALUES, lambda d: d.select("id", money_yuan("value").alias("yuan")), f"SELECT id, {YUAN_SQL} AS yuan FROM (SELECT *, regexp_replace(value, '[,，]', '', 'g') AS m FROM t)")

add("chk_04b_weighted_fixture", SCORES, lambda d: scores.weighted_mismatches(d, "raw", "weight", "weighted").select("bidder", "expert", "expected"), "SELECT bidder, expert, raw * weight / 100 AS expected FROM t WHERE abs(raw * weight / 100 - weighted) > 0.02")
add("ano_02b_expert_fixture", SCORES, lambda d: scores.leave_one_out(d, ["doc", "bidder", "lot", "factor"], "raw", "max_score").select("bidder", "expert", "deviation"), "SELECT bidder, expert, abs(raw - (s - raw) / (n - 1)) AS deviation FROM (SELECT *, sum(raw) OVER g AS s, count(*) OVER g AS n FROM t WINDOW g AS (PARTITION BY doc, bidder, lot, factor)) WHERE n >= 3 AND abs(raw - (s - raw) / (n - 1)) >= 8")
add("agg_13_expert_count", SCORES, lambda d: d.agg(F.count_distinct("expert").alias("experts")).withColumn("status", F.when((F.col("experts") < 5) | (F.col("experts") % 2 == 0), "human_review").otherwise("passed")), "SELECT count(DISTINCT expert) AS experts, CASE WHEN count(DISTINCT expert) < 5 OR count(DISTINCT expert) % 2 = 0 THEN 'human_review' ELSE 'passed' END AS status FROM t")
add("ano_04b_price_fixture", OPENINGS, lambda d: scores.price_progression(d, "lot", "price"), """SELECT lot, first_cents, middle_cents, last_cents, gap_cents FROM (
  SELECT x.lot, x.cents AS first_cents, y.cents AS middle_cents, 2 * y.cents - x.cents AS last_cents, y.cents - x.cents AS gap_cents, row_number() OVER (PARTITION BY x.lot ORDER BY x.cents DESC, y.cents) AS r
  FROM c x JOIN c y ON x.lot = y.lot AND y.cents > x.cents JOIN c z ON z.lot = x.lot AND z.cents = 2 * y.cents - x.cents) WHERE r = 1""")
ORACLE["ano_04b_price_fixture"] = ORACLE["ano_04b_price_fixture"].replace(" SELECT lot, first_cents", ", c AS (SELECT DISTINCT lot, CAST(round(price * 100) AS BIGINT) AS cents FROM t WHERE price IS NOT NULL) SELECT lot, first_cents", 1)
add("chk_08b_price_fixture", OPENINGS, lambda d: scores.conflicting_values(d, ["bidder", "lot"], "price", 2).select("bidder", "lot", "n_values"), "SELECT bidder, lot, count(DISTINCT round(price, 2)) AS n_values FROM t GROUP BY 1, 2 HAVING count(DISTINCT round(price, 2)) >= 2")


def issues(d: DataFrame) -> DataFrame:
    return d.withColumn("evidence", F.array("quote"))


STATE_SQL = "(requires_human_review OR detection_status IN ('not_detected', 'not_checked', 'low_confidence', 'mismatch', 'uncertain'))"
add("lif_00_issue_state", ISSUES, lambda d: lifecycle.quality_report(issues(d)).select("seq", "assessment", "final_status"), f"SELECT seq, CASE WHEN {STATE_SQL} THEN '待人工判断' WHEN final_status = 'passed' THEN '未发现问题' ELSE '明确问题' END AS assessment, CASE WHEN {STATE_SQL} THEN 'human_review' WHEN final_status = 'passed' THEN 'passed' ELSE 'confirmed_issue' END AS final_status FROM t")
MERGEABLE = ", ".join(f"'{x}'" for x in K.MERGEABLE_TYPES)
add("lif_04_merge_signals", ISSUES, lambda d: lifecycle.merge_signals(issues(d)).select("location", "n", "risk_level", "confidence", F.array_join("evidence", "|").alias("quotes")), "")
ORACLE["lif_04_merge_signals"] = f"""WITH {values(ISSUES, 't')}, s AS (SELECT *, trim(source_location) AS location FROM t WHERE owner = '{K.ANOMALY}' AND issue_type IN ({MERGEABLE}) AND trim(source_location) <> ''),
q AS (SELECT location, string_agg(quote, '|' ORDER BY first) AS quotes FROM (SELECT location, quote, min(seq) AS first FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT location, count(*) AS n, CASE WHEN bool_or(risk_level = '高') OR count(*) >= 3 THEN '高' ELSE '中' END AS risk_level, max(confidence) AS confidence, any_value(quotes) AS quotes FROM s JOIN q USING (location) GROUP BY 1 HAVING count(*) > 1"""
add("set_05_dedupe_anomaly", ISSUES, lambda d: lifecycle.dedupe_anomaly(issues(d)).select("seq"), "SELECT min(seq) AS seq FROM t GROUP BY issue_type, source_location, quote")
add("set_04_dedupe_compliance", ISSUES, lambda d: lifecycle.dedupe_compliance(issues(d)).select("seq"), "SELECT min(seq) AS seq FROM t WHERE issue_type <> '跨文件基础信息不一致' GROUP BY source_file, issue_type, quote")
add("set_09_upsert_reviews", REVIEWS, lambda d: lifecycle.latest_reviews(d).select("seq", "decision"), "SELECT seq, decision FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY seq DESC) AS r FROM t) WHERE r = 1 OR issue_id IS NULL")
add("agg_05_status_counts", ISSUES, lambda d: d.rollup("owner", "risk_level").agg(F.count("*").alias("n")), "SELECT owner, risk_level, count(*) AS n FROM t GROUP BY ROLLUP (owner, risk_level)")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derived(spark, sf_dir, ISSUES).select(F.concat(F.lit("I"), F.col("seq").cast("string")).alias("issue_id"), "description", "final_status", "confidence")
    return lifecycle.apply_decisions(found, lifecycle.latest_reviews(derived(spark, sf_dir, REVIEWS)))


QUERIES["lif_07_apply_decisions"] = QUERIES["joi_14_review_decisions"] = decided
ORACLE["lif_07_apply_decisions"] = ORACLE["joi_14_review_decisions"] = f"""WITH {values(ISSUES, 't')}, {values(REVIEWS, 'r')}, l AS (SELECT issue_id, arg_max(decision, seq) AS decision, arg_max(corrected_text, seq) AS text FROM r WHERE issue_id IS NOT NULL GROUP BY 1)
SELECT 'I' || seq AS issue_id, CASE WHEN decision = '需修改' AND text <> '' THEN text ELSE description END AS description,
  CASE WHEN decision IN ('正确', '需修改') THEN 'confirmed_issue' WHEN decision = '误判' THEN 'normal' ELSE final_status END AS final_status, CASE WHEN decision IN ('正确', '需修改') THEN CAST(1.0 AS DOUBLE) ELSE confidence END AS confidence
FROM t LEFT JOIN l ON l.issue_id = 'I' || seq UNION ALL SELECT NULL, corrected_text, 'confirmed_issue', 1.0 FROM r WHERE issue_id IS NULL AND decision = '漏判'"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's rules by group, for each source of documents as a review."""
    sources = docs(spark, sf_dir).select(F.coalesce("source", F.lit("?")).alias("task")).distinct()
    each = F.explode(F.array(*[F.struct(F.lit(r[0][:2]).alias("group_code"), F.lit(r[5]).alias("active")) for r in K.RULES]))
    return sources.select("task", each.alias("r")).groupBy("task", "r.group_code").agg(F.count("*").alias("n_rules"), F.count_if("r.active").alias("n_active"))


QUERIES["rul_00_catalogue"], ORACLE["rul_00_catalogue"] = catalogue, "SELECT task, group_code, n_rules, n_active FROM (VALUES ('P1', 12, 12), ('P2', 11, 11), ('P3', 18, 16)) AS t(group_code, n_rules, n_active), (SELECT DISTINCT coalesce(source, '?') AS task FROM documents)"
