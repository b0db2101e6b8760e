"""Reports as relations: rule results by group and status, with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

# The states of a rule in the order of a report, and how a report names them; names of totals.
STATUSES = {"passed": "通过", "confirmed_issue": "明确问题", "human_review": "待人工复核", "insufficient_data": "资料不足未执行", "not_applicable": "本次不适用", "disabled": "停用/合并"}
EXECUTED = ("passed", "confirmed_issue", "human_review")
ALL_TASKS, ALL_GROUPS = "全部", "合计"


def rules_summary(results: DataFrame) -> DataFrame:
    """SNK-08: (task, group_code, total, executed, and a count for each status).

    results: task, rule_id, status. A row for each task and group of rules, for each task, and one for all: grouping sets
    whose counts are partial before the one shuffle. Without results there are no rows. An unknown status
    counts in the total only; a null task is one task, named ''.
    """
    rows = results.select(F.coalesce("task", F.lit("")).alias("task"), F.substring("rule_id", 1, 2).alias("group_code"), "status")
    counts = [F.count("*").alias("total"), F.count_if(F.col("status").isin(*EXECUTED)).alias("executed"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES)]
    out = rows.groupingSets([("task", "group_code"), ("task",), ()], "task", "group_code").agg(*counts, F.grouping_id().alias("level"))
    task, group = F.when(F.col("level") == 3, ALL_TASKS).otherwise(F.col("task")), F.when(F.col("level") > 0, ALL_GROUPS).otherwise(F.col("group_code"))
    return out.select(task.alias("task"), group.alias("group_code"), "total", "executed", *STATUSES)


def rule_lines(results: DataFrame) -> DataFrame:
    """(task, group_code, rule_id, category, item, risk_level, state, detail) as a report prints them.

    results: task, rule_id, category, item, risk_level, status, execution_evidence, missing_inputs (arrays), reason. The
    detail is the evidence, else what is missing, else the reason.
    """
    names = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])
    given = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    parts = F.when(F.size(F.coalesce("execution_evidence", F.array().cast("array<string>"))) > 0, given("execution_evidence")).when(F.size(F.coalesce("missing_inputs", F.array().cast("array<string>"))) > 0, given("missing_inputs")).otherwise(F.filter(F.array(F.coalesce("reason", F.lit(""))), lambda x: x != ""))
    detail = F.coalesce(F.nullif(F.array_join(parts, "；"), F.lit("")), F.lit("无"))
    return results.select("task", F.substring("rule_id", 1, 2).alias("group_code"), "rule_id", "category", "item", "risk_level", F.coalesce(names[F.col("status")], F.col("status"), F.lit("")).alias("state"), detail.alias("detail"))


def report_title(report_type: Column, template_type: Column) -> Column:
    """PRJ-19"""
    either = lambda name: (report_type == name) | (template_type == name)
    return F.when(either("标准化评标报告"), "标准化评标报告").when(either("整改建议报告"), "评标核验整改建议报告").when(template_type == "简版管理层报告", F.concat(report_type, F.lit("（管理层简版）"))).when(template_type == "详细审查报告", F.concat(report_type, F.lit("（详细版）"))).otherwise(report_type)


def conclusions(issues: DataFrame, documents: DataFrame) -> DataFrame:
    """LIF-10: (task, owner, conclusion) for each owner's part of a task's findings, and for all of them under the owner ''.

    issues: task, owner, final_status. documents: task, page_count. Confirmed findings and those a person must decide are
    counted after their review. Every task of ``documents`` has all rows.
    """
    state = [F.count_if(F.col("final_status") == s).alias(n) for s, n in (("confirmed_issue", "yes"), ("human_review", "open"))]
    counts = issues.groupBy("task", F.col("owner").alias("who")).agg(*state, F.count("*").alias("n"))
    every = counts.groupBy("task").agg(*[F.sum(c).alias(f"all_{c}") for c in ("yes", "open", "n")])
    files = documents.groupBy("task").agg(F.count("*").alias("files"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))
    owners = (K.PARSER, K.COMPLIANCE, K.DATA, K.ANOMALY, K.REVIEWER, "")
    rows = files.withColumn("owner", F.explode(F.array(*map(F.lit, owners)))).join(counts.withColumnRenamed("who", "owner"), ["task", "owner"], "left").join(every, "task", "left")
    rows = rows.fillna(0, ["yes", "open", "n", "all_yes", "all_open", "all_n"])
    say = lambda text, *cols: F.format_string(text, *map(F.col, cols))
    # The sentences of a report.
    some, pages = (F.col("yes") + F.col("open")) > 0, F.when(F.col("pages") > 0, say("共%d页", "pages")).otherwise("")
    parsed = F.concat(say("完成%d份文档", "files"), pages, F.lit("的内容解析，并提取正文、章节、表格及关键业务字段。"), F.when(F.col("open") > 0, say("视觉或解析质量核验发现%d项待人工复核事项，已纳入最终问题清单。", "open")).otherwise("当前未形成需要输出的文档解析质量问题。"))
    text = {
        K.PARSER: parsed,
        K.COMPLIANCE: F.when(some, say("完成合规规则核验；经统一结果复核，形成明确问题%d项、待人工复核事项%d项。", "yes", "open")).otherwise("完成合规规则核验；经统一结果复核，当前未形成需要输出的明确或潜在合规问题。"),
        K.DATA: F.when(some, say("完成关键字段及相关数据交叉核验；经统一结果复核，形成明确问题%d项、待人工复核事项%d项。", "yes", "open")).otherwise("完成关键字段及相关数据交叉核验，当前未发现具有充分证据支持的数据一致性问题。"),
        K.ANOMALY: F.when(some, say("完成跨文件、跨主体及多信号关联分析；经统一结果复核，形成明确异常%d项、待人工复核线索%d项。", "yes", "open")).otherwise(F.concat(F.when(F.col("files") != 1, "当前材料").otherwise("基于当前单份材料"), F.lit("暂未发现可形成有效证据链的异常关联线索。"))),
        K.REVIEWER: say("已统一复核各专项智能体发现，最终确认明确问题%d项、待人工复核事项%d项。", "all_yes", "all_open"),
    }
    total = (
        F.when(F.col("all_n") == 0, "本次自动核验暂未发现证据充分的明确问题，亦无待人工复核事项。")
        .when(F.col("all_yes") == 0, say("本次自动核验暂未发现证据充分的明确问题，发现%d项待人工复核事项，建议核对相关原始材料后形成最终结论。", "all_open"))
        .when(F.col("all_open") == 0, say("本次自动核验形成明确问题%d项，未发现待人工复核事项，请按问题清单完成整改与闭环确认。", "all_yes"))
        .otherwise(say("本次自动核验形成明确问题%d项、待人工复核事项%d项；请优先处置明确问题，并核对相关原始材料后确认待复核事项。", "all_yes", "all_open"))
    )
    said = total
    for owner, own in text.items():
        said = F.when(F.col("owner") == owner, own).otherwise(said)
    return rows.select("task", "owner", said.alias("conclusion"))


def report_package(issues: DataFrame, documents: DataFrame, fields: DataFrame, reviewed: DataFrame) -> DataFrame:
    """LIF-09: a row for each task of ``documents``: counts, whether the report is ready and final, and the names it may show.

    issues: task, risk_level, final_status, n_evidence. documents: task, place, doc, parse_status. fields: doc, name, value,
    confidence, requires_human_review. reviewed: task, of those that people decided. A report is final once people have
    decided and nothing is open. A field of a task's first document is shown where it is sure and not open, and else is
    to be confirmed.
    """
    risks = [F.count_if(F.col("risk_level") == r).alias(n) for r, n in zip(K.RISK_ORDER, ("high", "medium", "low"), strict=True)]
    found = issues.groupBy("task").agg(F.count("*").alias("total"), *risks, F.count_if(F.col("final_status") == "confirmed_issue").alias("confirmed"), F.count_if(F.col("final_status") == "human_review").alias("pending"), F.count_if(F.col("n_evidence") == 0).alias("unproven"))
    held = documents.groupBy("task").agg(F.count("*").alias("documents"), F.count_if(F.col("parse_status") == "failed").alias("failed"), F.min_by("doc", "place").alias("doc"))
    shown = F.when((F.col("confidence") >= 0.75) & ~F.col("requires_human_review"), F.col("value")).when(F.col("value") != "", "待人工确认")
    names = ("project_name", "tenderer", "procurement_agency")
    display = fields.filter(F.col("name").isin(*names)).groupBy("doc").pivot("name", list(names)).agg(F.max(shown))
    people = reviewed.select("task").distinct().withColumn("people", F.lit(True))
    rows = held.join(found, "task", "left").fillna(0).join(display, "doc", "left").join(people, "task", "left")
    counts = ("total", "high", "medium", "low", "confirmed", "pending")
    ready = (F.col("unproven") == 0) & (F.col("failed") == 0)
    final = F.coalesce("people", F.lit(False)) & (F.col("pending") == 0)
    return rows.select("task", "documents", *counts, ready.alias("ready"), F.when(final, "正式核验版").otherwise("待复核版").alias("status"), *[F.coalesce(n, F.lit("")).alias(n) for n in names])
