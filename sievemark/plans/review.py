"""A whole review in stages: documents to findings, evidence, people's decisions, conclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..exprs import clean_text
from ..operators import text
from . import lifecycle
from .stages import Outcome, Stage, StagedRun, Tables

ISSUE = ("seq", "owner", "risk_level", "issue_type", "source_file", "source_location", "description", "evidence", "requires_human_review", "detection_status", "final_status", "confidence")


def _issues(rows: DataFrame, owner: str, issue_type: str, risk: str, description: Column, evidence: Column, review: bool, confidence: float) -> DataFrame:
    place = F.concat(F.lit("文档"), F.col("document_id").cast("string"))
    made = {"owner": F.lit(owner), "risk_level": F.lit(risk), "issue_type": F.lit(issue_type), "source_file": F.col("file_name"), "source_location": place, "description": description, "evidence": evidence, "requires_human_review": F.lit(review), "detection_status": F.lit(""), "final_status": F.lit("confirmed"), "confidence": F.lit(confidence)}
    return rows.withColumns(made).select("document_id", *ISSUE[1:])


def parse(documents: DataFrame) -> DataFrame:
    """(document_id, file_name, content) with cleaned text, from (document_id, file_name, text)."""
    return documents.select("document_id", F.coalesce("file_name", F.lit("")).alias("file_name"), clean_text(F.coalesce("text", F.lit(""))).alias("content"))


def check_compliance(parsed: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """A finding for each line with one of the words, eight of a document at most."""
    rows = parsed.withColumn("line", F.explode(text.keyword_lines("content", words, 8)))
    return _issues(rows, K.COMPLIANCE, "限制性条款", "中", F.concat(F.lit("条款："), F.col("line")), F.array("line"), False, 0.85)


def check_data(parsed: DataFrame) -> DataFrame:
    """A finding for each document without readable text."""
    rows = parsed.filter((F.length("content") < 20) | text.garbled("content"))
    return _issues(rows, K.DATA, "文本不可读", "低", F.lit("正文过短或含大量乱码"), F.array().cast("array<string>"), False, 0.7)


def analyse_anomalies(parsed: DataFrame, pattern: str) -> DataFrame:
    """A finding for each document with a telling passage; it needs a person."""
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    rows = parsed.withColumn("found", F.array_distinct(found)).filter(F.size("found") > 0)
    return _issues(rows, K.ANOMALY, "敏感信息", "高", F.lit("正文含敏感信息"), F.col("found"), True, 0.6)


def merge(parts: list[DataFrame]) -> DataFrame:
    """All findings once: numbered by what they say, deduplicated, with ids and states."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("seq", F.struct("document_id", "owner", "issue_type", "evidence"))
    issues = lifecycle.quality_report(lifecycle.with_issue_id(lifecycle.dedupe_compliance(every.select(*ISSUE))))
    return issues.withColumn("seq", F.col("issue_id"))


def decide(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings after people's decisions (seq, issue_id, decision, corrected_text)."""
    after = lifecycle.apply_decisions(issues.select("issue_id", "description", "final_status", "confidence"), lifecycle.latest_reviews(decisions))
    kept = issues.drop("description", "final_status", "confidence")
    return after.join(kept, "issue_id", "left")


def summary(issues: DataFrame) -> DataFrame:
    """(issue_type, risk_level, final_status, n)"""
    return issues.groupBy(F.coalesce("issue_type", F.lit("漏判")).alias("issue_type"), F.coalesce("risk_level", F.lit("中")).alias("risk_level"), "final_status").agg(F.count("*").alias("n"))


def stages(words: tuple[str, ...], pattern: str) -> list[Stage]:
    def contexts(t: Tables) -> DataFrame:
        return t["parsed"].select("file_name", "document_id", F.col("document_id").alias("place"), F.lit("text").alias("part"), F.lit(0).alias("ord"), F.lit("").alias("section"), F.lit(None).cast("int").alias("page"), "content")

    return [
        Stage("parsed", lambda t: parse(t["documents"])),
        Stage("compliance", lambda t: check_compliance(t["parsed"], words)),
        Stage("data", lambda t: check_data(t["parsed"])),
        Stage("anomaly", lambda t: analyse_anomalies(t["parsed"], pattern)),
        Stage("findings", lambda t: merge([t[x] for x in ("compliance", "data", "anomaly")])),
        Stage("evidenced", lambda t: lifecycle.enrich_evidence(t["findings"], contexts(t))),
        Stage("decided", lambda t: decide(t["evidenced"], t["decisions"]), waits_for="decisions"),
        Stage("summary", lambda t: summary(t["decided"])),
    ]


def pending(outcome: Outcome) -> DataFrame:
    """The findings that a run waits for a person to decide."""
    return outcome.tables["evidenced"].filter("requires_human_review OR risk_level = '高'")


def run_review(spark: SparkSession, root: str, documents: DataFrame, words: tuple[str, ...], pattern: str, decisions: DataFrame | None = None) -> Outcome:
    """A review of ``documents`` (document_id, file_name, text) in the folder ``root``, begun or gone on with.

    Without decisions it ends waiting, with the findings to decide in ``pending``; called again with them it goes on from
    there. Null texts are empty, null file names blank; repeated rows give one finding.
    """
    run = StagedRun(spark, root, stages(words, pattern), {"documents": documents})
    if decisions is not None:
        run.hand_in("decisions", decisions)
    return run.run()
