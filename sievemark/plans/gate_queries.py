"""Queries of the quality gate, marks, covers and reports over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import gate
from . import reports
from .driver_queries import ORACLE, docs, query, table
from .fixture_queries import add, values

#: documents as parsed files: kinds by language, scans where there is little text, read by OCR in some sources.
KIND = "CASE lang WHEN 'en' THEN '招标文件' WHEN 'de' THEN '评标报告' WHEN 'fr' THEN '法规依据' ELSE '业务文件' END"
FILE = ("doc_id AS doc", "text", f"{KIND} AS file_type", "n_chars < 200 AS is_scanned", "source = 'web' AS ocr_applied", "(n_chars % 100) / 100.0 AS ocr_confidence")
#: labels as fields: a name for all, a budget for good ones, a limit for those that aren't toxic.
FIELDS = """SELECT doc_id AS doc, 'project_name' AS name, CASE WHEN quality = 1 THEN 0.9 ELSE 0.6 END AS confidence, toxic = 1 AS requires_human_review FROM labels
UNION ALL SELECT doc_id, 'budget', 0.8, false FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'price_limit', 0.7, false FROM labels WHERE toxic = 0"""


def files(spark, sf):
    return docs(spark, sf).selectExpr(*FILE)


def fields(spark, sf):
    labels = table(spark, sf, "labels")
    one = lambda name, sure, review: F.struct(F.lit(name).alias("name"), sure.cast("double").alias("confidence"), review.alias("requires_human_review"))
    made = F.array_compact(F.array(one("project_name", F.when(F.col("quality") == 1, 0.9).otherwise(0.6), F.col("toxic") == 1), F.when(F.col("quality") == 1, one("budget", F.lit(0.8), F.lit(False))), F.when(F.col("toxic") == 0, one("price_limit", F.lit(0.7), F.lit(False)))))
    return labels.select(F.col("doc_id").alias("doc"), F.explode(made).alias("f")).select("doc", "f.*")


CHECKS_SQL = f"""f AS (SELECT {', '.join(FILE)} FROM documents), l AS ({FIELDS}),
w AS (SELECT doc, unnest(CASE file_type WHEN '招标文件' THEN ['project_name', 'budget', 'price_limit'] WHEN '法规依据' THEN [] ELSE ['project_name'] END) AS name FROM f),
s AS (SELECT w.doc, count(*) FILTER (l.name IS NULL) AS missing, count(*) FILTER (l.confidence < 0.75) AS unsure, count(*) FILTER (l.requires_human_review) AS open FROM w LEFT JOIN l USING (doc, name) GROUP BY 1),
c AS (SELECT f.doc, coalesce(text, '') = '' AS none, coalesce(is_scanned, false) AND (NOT coalesce(ocr_applied, false) OR ocr_confidence < 0.75) AS unread, coalesce(missing + unsure + open, 0) > 0 AS bad,
  length(text) - length(replace(text, chr(65533), '')) > greatest(3.0, length(text) / 200.0) AS broken FROM f LEFT JOIN s USING (doc)),
q AS (SELECT doc, 'text_extracted' AS code, CASE WHEN none THEN 'failed' ELSE 'passed' END AS status FROM c UNION ALL SELECT doc, 'scan_detection', CASE WHEN unread THEN 'warning' ELSE 'passed' END FROM c
  UNION ALL SELECT doc, 'key_fields', CASE WHEN bad THEN 'warning' ELSE 'passed' END FROM c UNION ALL SELECT doc, 'encoding_quality', CASE WHEN coalesce(broken, false) THEN 'warning' ELSE 'passed' END FROM c)"""


@query(f"WITH {CHECKS_SQL} SELECT doc, code, status, status <> 'passed' AS requires_human_review FROM q")
def qlt_01_quality_checks(spark, sf):
    return gate.quality_checks(files(spark, sf), fields(spark, sf)).select("doc", "code", "status", "requires_human_review")


ISSUE_VALUES = ", ".join(f"('{code}', '{kind}', '{advice}')" for code, (kind, advice) in gate.CHECK_ISSUES.items())


@query(f"""WITH {CHECKS_SQL} SELECT doc, kind AS issue_type, CASE status WHEN 'failed' THEN '中' ELSE '低' END AS risk_level, '质量检查/' || code AS source_location, advice AS suggestion, CASE status WHEN 'failed' THEN 0.35::DOUBLE ELSE 0.55::DOUBLE END AS confidence
FROM q JOIN (VALUES {ISSUE_VALUES}) n(code, kind, advice) USING (code) WHERE status <> 'passed'""")
def qlt_02_quality_issues(spark, sf):
    return gate.quality_issues(gate.quality_checks(files(spark, sf), fields(spark, sf))).drop("description")


@query(f"""WITH f AS (SELECT doc_id AS doc, {KIND} AS kind FROM documents), l AS ({FIELDS}), w AS (SELECT doc, unnest(CASE kind WHEN '招标文件' THEN ['project_name', 'budget', 'price_limit'] ELSE ['project_name'] END) AS name FROM f),
s AS (SELECT w.doc, bool_or(l.name IS NULL OR l.confidence < 0.75 OR l.requires_human_review) AS lacks FROM w LEFT JOIN l USING (doc, name) GROUP BY 1)
SELECT f.doc, lacks OR f.doc NOT IN (SELECT doc_id FROM documents WHERE source <> 'web') AS needed FROM f JOIN s USING (doc)""")
def flt_24_needs_enhancement(spark, sf):
    """Documents of one source have no heading but the text's own."""
    titles = docs(spark, sf).select(F.col("doc_id").alias("doc"), F.when(F.col("source") != "web", F.col("source")).otherwise("文档正文").alias("title"))
    return gate.needs_enhancement(files(spark, sf).select("doc", "file_type"), fields(spark, sf), titles)


@query("SELECT conv_id AS doc, coalesce(avg(CASE WHEN trim(text) <> '' THEN (length(text) % 100) / 100.0 END), 0.0) AS confidence FROM conversations GROUP BY 1")
def agg_12_ocr_confidence(spark, sf):
    return gate.ocr_confidence(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), "text", (F.length("text") % 100 / 100.0).alias("confidence")))


@query("""WITH p AS (SELECT l_orderkey, count(*) AS n, round(sum(round(l_extendedprice, 2)), 2) AS calculated FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey, n, calculated, CASE WHEN o_orderkey % 3 = 0 THEN calculated ELSE round(o_totalprice, 2) END AS total FROM orders JOIN p ON l_orderkey = o_orderkey)
SELECT o_orderkey AS doc, calculated, total FROM t WHERE n >= 2 AND abs(calculated - total) > greatest(0.01, 1e-9 * greatest(calculated, total))""")
def chk_10_price_sum(spark, sf):
    """Orders as bids whose text gives each position's price and a total, which is right for every third."""
    price = lambda c: F.round(c, 2).cast("decimal(20,2)").cast("string")
    bids = table(spark, sf, "lineitem").select("l_orderkey", F.round("l_extendedprice", 2).alias("p")).groupBy("l_orderkey").agg(F.collect_list("p").alias("prices"), F.round(F.sum("p"), 2).alias("sum"))  # an order has a few lines
    clauses = F.transform("prices", lambda p, i: F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("项报价为人民币"), price(p), F.lit("元")))
    bids = bids.select("l_orderkey", F.array_join(clauses, "；").alias("parts"), "sum")
    rows = table(spark, sf, "orders").join(bids, F.col("l_orderkey") == F.col("o_orderkey"))
    total = F.when(F.col("o_orderkey") % 3 == 0, F.col("sum")).otherwise(F.col("o_totalprice"))
    text = F.concat(F.lit("预算报价为人民币1元。\n"), "parts", F.lit("。\n投标总价为人民币"), price(total), F.lit("元。"))
    return gate.price_sums(rows.select(F.col("o_orderkey").alias("doc"), text.alias("text"))).select("doc", "calculated", "total")


COVERS = ("id int, text string", [
    (1, "某市财政局\n智慧 校园建设项目\n采购文件\n二〇二六年"), (2, "政府采购项目\n数据中心运维服务工程采购\n项目编号：A-1"), (3, "目录\n第一章"), (4, "某大学\n图书馆改造工程\n图书馆改造升级工程项目采购。"), (5, ""), (6, None), (7, "短\n采购人：甲项目采购"),
])
add("ext_04_cover_project_name", COVERS, lambda d: d.select("id", gate.cover_project_name("text").alias("name")), r"""SELECT id, (SELECT arg_max(x, contains(x, '项目')::INT * 1000000 + length(x) * 1000 - i) FROM (
  SELECT regexp_replace(regexp_replace(u.x, '\s+', '', 'g'), '^[：:。、；;]+|[：:。、；;]+$', '', 'g') AS x, u.i AS i FROM (SELECT unnest(list_transform(string_split(left(coalesce(text, ''), 3000), chr(10))[1:50], lambda x, i: {'x': x, 'i': i})) AS u))
  WHERE length(x) BETWEEN 4 AND 100 AND NOT regexp_matches(x, '(采购人|招标人|代理机构|项目编号|日期|目录|投标人)[:：]') AND regexp_matches(x, '项目|工程') AND regexp_matches(x, '采购|招标|建设|服务|维护|运维|改造|升级|评标|工程')
    AND NOT regexp_full_match(x, '[\x{4e00}-\x{9fff}]{0,10}(政府)?(采购|招标)项目') AND NOT regexp_full_match(x, '[\x{4e00}-\x{9fff}A-Za-z0-9（）()·]+(大学|学院|公司|中心|局|委员会)')) AS name FROM t""")

LETTERS = ("id int, text string", [
    (1, "致 某市财政局：\n供应商：甲 科技有限公司（盖章）\n投标人：甲科技有限公司"), (2, "合作方  乙研究院\n供应商：应当为公司"), (3, "承诺单位：丙大学，投标人: 丁"), (4, "致\n某县 教育局:"), (5, None), (6, "无"),
])
PARTIES = r"list_concat(regexp_extract_all(b, '(?:合作方|投标人|供应商|受邀方|承诺单位)\s*[:：]\s*([^\n，。；:：]{2,80})', 1), regexp_extract_all(b, '(?:合作方|投标人|供应商|受邀方|承诺单位)\s+：?\s*([^\n，。；:：]{2,80})', 1))"
add("ext_05_response_entities", LETTERS, lambda d: d.select("id", F.array_join(gate.response_entities("text"), "|").alias("entities"), gate.response_tenderer("text").alias("tenderer")), rf"""SELECT id, array_to_string(list_filter(list_transform(list_transform({PARTIES}, lambda x: regexp_replace(x, '\s+', '', 'g')), lambda x: regexp_replace(x, '^[（）()盖章签字]+|[（）()盖章签字]+$', '', 'g')),
  lambda x, i: length(x) BETWEEN 2 AND 50 AND regexp_matches(x, '公司|集团|大学|学院|研究院|研究所|中心|事务所|合作社|厂|局|院|所') AND NOT regexp_matches(x, '应当|不得|其他供应商|采购人|代理机构|响应文件')
    AND list_position(list_transform(list_transform({PARTIES}, lambda y: regexp_replace(y, '\s+', '', 'g')), lambda y: regexp_replace(y, '^[（）()盖章签字]+|[（）()盖章签字]+$', '', 'g')), x) = i), '|') AS entities,
  nullif(regexp_replace(regexp_extract(b, '(?:^|\n)\s*致\s*([^\n:：]{{4,100}})\s*[:：]', 1), '\s+', '', 'g'), '') AS tenderer FROM (SELECT id, coalesce(text, '') AS b FROM t)""")

SIGNED = ("id int, page int, text string", [(1, 1, "投标人（盖章）：\n法定代表人（签字）：\n投标人（盖章）："), (2, 2, "正文\n加盖公章：  评委签字："), (3, 1, "无"), (4, 1, None)])
MARK_SQL = "m AS (SELECT DISTINCT id, target, page, left(x, 200) AS source_text FROM (SELECT id, page, trim(unnest(string_split(text, chr(10)))) AS x FROM t), (VALUES " + ", ".join(f"('{t}', '{p}')" for t, p in gate.MARKS.items()) + ") p(target, pattern) WHERE regexp_matches(x, pattern))"
add("ext_17_expected_marks", SIGNED, lambda d: gate.expected_marks(d.withColumnRenamed("id", "doc")).select(F.col("doc").alias("id"), "target", "page", "source_text"), "")
ORACLE["ext_17_expected_marks"] = f"WITH {values(SIGNED, 't')}, {MARK_SQL} SELECT * FROM m"


def _checks(d):
    pages = d.withColumnRenamed("id", "doc")
    sure = lambda n: (F.col("doc") % n / float(n))
    found = pages.filter("doc % 3 <> 0").select("doc", F.when(F.col("doc") % 2 == 0, "seal").otherwise("signature").alias("target"), "page", (0.5 + 0.5 * sure(5)).alias("confidence"), sure(7).alias("ocr_confidence"), F.when(F.col("doc") % 11 == 0, False).alias("matches_entity"))
    return gate.visual_checks(found, gate.expected_marks(pages)).withColumnRenamed("doc", "id")


VISUAL_SQL = f"""WITH {values(SIGNED, 't')}, {MARK_SQL}, f AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'seal' ELSE 'signature' END AS target, page, 0.5 + 0.5 * (id % 5) / 5.0 AS c, (id % 7) / 7.0 AS o, id % 11 = 0 AS other FROM t WHERE id % 3 <> 0),
v AS (SELECT id, target, page, EXISTS (SELECT 1 FROM m WHERE (m.id, m.target, m.page) = (f.id, f.target, f.page)) AS expected, CASE WHEN other THEN 'mismatch' WHEN c < 0.8 OR (target = 'seal' AND o < 0.6) THEN 'low_confidence' ELSE 'detected' END AS status FROM f
  UNION ALL SELECT id, target, page, true, CASE target WHEN 'seal' THEN 'not_detected' ELSE 'not_checked' END FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE (m.id, m.target, m.page) = (f.id, f.target, f.page)))"""
add("vis_01_visual_checks", SIGNED, lambda d: _checks(d).select("id", "target", "page", "expected", "status", "requires_human_review"), "")
ORACLE["vis_01_visual_checks"] = f"{VISUAL_SQL} SELECT *, status <> 'detected' AS requires_human_review FROM v"
add("vis_02_visual_issues", SIGNED, lambda d: gate.visual_issues(_checks(d).withColumnRenamed("id", "doc")).withColumnRenamed("doc", "id"), "")
ORACLE["vis_02_visual_issues"] = f"{VISUAL_SQL} SELECT id, target, page, status, count(*) AS n FROM v WHERE status <> 'detected' GROUP BY ALL"


@query("SELECT doc_id, coalesce(lang, '') || '|' || coalesce(source, '') || CASE WHEN n_chars % 2 = 0 THEN '/a b|' ELSE '' END AS cells FROM documents WHERE coalesce(lang, '') <> '' OR coalesce(source, '') <> '' OR n_chars % 2 = 0")
def prj_02_normalize_table(spark, sf):
    """A table for each document: its language and source, a blank row, and in some a row with stray white space."""
    row = lambda *cells: F.array(*cells)
    rows = F.array(row(F.col("lang"), F.concat(F.lit(" "), F.coalesce("source", F.lit("")))), row(F.lit(None).cast("string"), F.lit(" \t")), F.when(F.col("n_chars") % 2 == 0, row(F.lit("a \t b\r\n"), F.lit(None).cast("string"))).otherwise(row(F.lit(""), F.lit("\x00"))))
    return docs(spark, sf).select("doc_id", F.array_join(F.transform(gate.normalize_table(rows), lambda r: F.array_join(r, "|")), "/").alias("cells")).filter("cells <> ''")


@query("""WITH r AS (SELECT source AS doc, doc_id AS seq, trim(lang) AS evidence, CAST(n_chars % 5 AS VARCHAR) AS issue_type, 0 AS r FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source, doc_id, trim(lang), CAST(n_chars % 5 AS VARCHAR), 1 FROM documents WHERE doc_id % 2 = 1)
SELECT doc, seq, evidence, issue_type FROM (SELECT *, row_number() OVER (PARTITION BY doc, coalesce(evidence, ''), issue_type ORDER BY r, seq) AS n FROM r) WHERE n = 1""")
def set_10_merge_payloads(spark, sf):
    rows = docs(spark, sf).select(F.col("source").alias("doc"), F.col("doc_id").alias("seq"), F.col("lang").alias("evidence"), (F.col("n_chars") % 5).cast("string").alias("issue_type"))
    return gate.merge_payloads(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")).select("doc", "seq", "evidence", "issue_type")


@query("SELECT 'I' || doc_id AS issue_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def joi_15_allowed_issues(spark, sf):
    name = F.concat(F.lit("I"), F.col("doc_id").cast("string")).alias("issue_id")
    return gate.allowed_issues(docs(spark, sf).select(name, "lang"), table(spark, sf, "labels").filter("quality = 1").select(name))


#: documents as findings of their source's review; labels decide them.
FINDING = f"SELECT coalesce(source, '?') AS task, CASE doc_id % 5 WHEN 0 THEN '{K.PARSER}' WHEN 1 THEN '{K.COMPLIANCE}' WHEN 2 THEN '{K.DATA}' WHEN 3 THEN '{K.ANOMALY}' ELSE '{K.REPORTER}' END AS owner, CASE WHEN toxic = 1 THEN '高' WHEN quality = 0 THEN '中' ELSE '低' END AS risk_level, CASE WHEN toxic = 1 THEN 'human_review' WHEN quality = 0 THEN 'confirmed_issue' ELSE 'normal' END AS final_status, CASE WHEN lang IS NULL THEN 0 ELSE 1 END AS n_evidence FROM documents JOIN labels USING (doc_id) WHERE lang <> 'es'"


def task_findings(spark, sf):
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("lang <> 'es'")
    owner = F.element_at(F.array(*map(F.lit, (K.PARSER, K.COMPLIANCE, K.DATA, K.ANOMALY, K.REPORTER))), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(F.coalesce("source", F.lit("?")).alias("task"), owner.alias("owner"), F.when(F.col("toxic") == 1, "高").when(F.col("quality") == 0, "中").otherwise("低").alias("risk_level"), F.when(F.col("toxic") == 1, "human_review").when(F.col("quality") == 0, "confirmed_issue").otherwise("normal").alias("final_status"), F.when(F.col("lang").isNull(), 0).otherwise(1).alias("n_evidence"))


@query(f"""WITH i AS ({FINDING}), d AS (SELECT coalesce(source, '?') AS task, count(*) AS files, sum(n_chars // 1000) AS pages FROM documents GROUP BY 1),
c AS (SELECT task, owner, count(*) FILTER (final_status = 'confirmed_issue') AS yes, count(*) FILTER (final_status = 'human_review') AS open FROM i GROUP BY 1, 2),
a AS (SELECT task, sum(yes) AS yes, sum(open) AS open FROM c GROUP BY 1)
SELECT d.task, '{K.COMPLIANCE}' AS owner, CASE WHEN coalesce(yes + open, 0) > 0 THEN '完成合规规则核验；经统一结果复核，形成明确问题' || yes || '项、待人工复核事项' || open || '项。' ELSE '完成合规规则核验；经统一结果复核，当前未形成需要输出的明确或潜在合规问题。' END AS conclusion FROM d LEFT JOIN c ON c.task = d.task AND c.owner = '{K.COMPLIANCE}'
UNION ALL SELECT d.task, '{K.PARSER}', '完成' || files || '份文档' || CASE WHEN pages > 0 THEN '共' || pages || '页' ELSE '' END || '的内容解析，并提取正文、章节、表格及关键业务字段。' || CASE WHEN open > 0 THEN '视觉或解析质量核验发现' || open || '项待人工复核事项，已纳入最终问题清单。' ELSE '当前未形成需要输出的文档解析质量问题。' END FROM d LEFT JOIN c ON c.task = d.task AND c.owner = '{K.PARSER}'
UNION ALL SELECT d.task, '', CASE WHEN a.task IS NULL THEN '本次自动核验暂未发现证据充分的明确问题，亦无待人工复核事项。' WHEN yes = 0 THEN '本次自动核验暂未发现证据充分的明确问题，发现' || open || '项待人工复核事项，建议核对相关原始材料后形成最终结论。' WHEN open = 0 THEN '本次自动核验形成明确问题' || yes || '项，未发现待人工复核事项，请按问题清单完成整改与闭环确认。' ELSE '本次自动核验形成明确问题' || yes || '项、待人工复核事项' || open || '项；请优先处置明确问题，并核对相关原始材料后确认待复核事项。' END FROM d LEFT JOIN a ON a.task = d.task""")
def lif_10_conclusions(spark, sf):
    files_ = docs(spark, sf).select(F.coalesce("source", F.lit("?")).alias("task"), F.expr("n_chars div 1000").alias("page_count"))
    return reports.conclusions(task_findings(spark, sf), files_).filter(F.col("owner").isin(K.COMPLIANCE, K.PARSER, ""))


@query(f"""WITH i AS ({FINDING}), d AS (SELECT coalesce(source, '?') AS task, doc_id, n_chars < 5 AS failed FROM documents), f AS (SELECT task, min(doc_id) AS doc_id, count(*) AS documents, count(*) FILTER (failed) AS failed FROM d GROUP BY 1),
c AS (SELECT task, count(*) AS total, count(*) FILTER (risk_level = '高') AS high, count(*) FILTER (risk_level = '中') AS medium, count(*) FILTER (risk_level = '低') AS low, count(*) FILTER (final_status = 'confirmed_issue') AS confirmed, count(*) FILTER (final_status = 'human_review') AS pending FROM i GROUP BY 1)
SELECT f.task, documents, coalesce(total, 0) AS total, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(confirmed, 0) AS confirmed, coalesce(pending, 0) AS pending, failed = 0 AS ready,
  CASE WHEN length(f.task) % 2 = 0 AND coalesce(pending, 0) = 0 THEN '正式核验版' ELSE '待复核版' END AS status, CASE WHEN quality IS NULL THEN '' WHEN quality = 1 AND toxic = 0 THEN '项目' || f.doc_id ELSE '待人工确认' END AS project_name
FROM f LEFT JOIN c ON c.task = f.task LEFT JOIN labels ON labels.doc_id = f.doc_id""")
def lif_09_report_package(spark, sf):
    d = docs(spark, sf).select(F.coalesce("source", F.lit("?")).alias("task"), F.col("doc_id").alias("place"), F.col("doc_id").alias("doc"), F.when(F.col("n_chars") < 5, "failed").otherwise("success").alias("parse_status"))
    names = table(spark, sf, "labels").select(F.col("doc_id").alias("doc"), F.lit("project_name").alias("name"), F.concat(F.lit("项目"), F.col("doc_id").cast("string")).alias("value"), F.when(F.col("quality") == 1, 0.9).otherwise(0.5).alias("confidence"), (F.col("toxic") == 1).alias("requires_human_review"))
    people = d.select("task").distinct().filter(F.length("task") % 2 == 0)
    return reports.report_package(task_findings(spark, sf), d, names, people).drop("tenderer", "procurement_agency")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN '标准化评标报告' WHEN lang = 'de' THEN '评标核验整改建议报告' WHEN n_chars % 2 = 0 THEN coalesce(source, '') || '（管理层简版）' ELSE coalesce(source, '') END AS title FROM documents")
def prj_19_report_title(spark, sf):
    kind = F.when(F.col("lang") == "en", "标准化评标报告").otherwise(F.coalesce("source", F.lit("")))
    form = F.when(F.col("lang") == "de", "整改建议报告").when(F.col("n_chars") % 2 == 0, "简版管理层报告").otherwise("")
    return docs(spark, sf).select("doc_id", reports.report_title(kind, form).alias("title"))
