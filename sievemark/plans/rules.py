"""The review catalogue as a relation, and executors that give (rule_id, status) from record relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..exprs import contains_any
from ..operators import scores

SCHEMA = "rule_id string, category string, item string, owner string, risk_level string, active boolean, conditional boolean"


def catalogue(spark: SparkSession) -> DataFrame:
    kinds = [c.split() for c in SCHEMA.split(", ")]
    rows = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(r, kinds, strict=True)]) for r in K.RULES])
    return spark.range(1, numPartitions=1).select(F.inline(rows)).withColumn("group_code", F.substring("rule_id", 1, 2))


def status(bad: Column, any_: Column) -> Column:
    """passed, human_review where something is bad, and without data insufficient_data."""
    return F.when(~any_, "insufficient_data").when(bad, "human_review").otherwise("passed")


def _row(df: DataFrame, rule_id: str, bad: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).select(F.lit(rule_id).alias("rule_id"), status(F.col("bad") > 0, F.col("n") > 0).alias("status"))


def weighted_scores(details: DataFrame, rule_id: str, word: str, *, percent_weights: bool = True, tolerance: float = 0.01) -> DataFrame:
    """P3-08 and P3-10: raw times weight against the weighted score of the factors named."""
    rows = details.filter(F.contains("factor", F.lit(word))).filter("raw_score IS NOT NULL AND weight IS NOT NULL AND weighted_score IS NOT NULL")
    weight = F.when(F.lit(percent_weights) & (F.col("weight") > 1), F.col("weight") / 100).otherwise(F.col("weight"))
    return _row(rows, rule_id, F.abs(F.col("raw_score") * weight - F.col("weighted_score")) > tolerance)


def totals(details: DataFrame, summaries: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """P3-13: the sum of the factors' means against the recorded total."""
    own = scores.mean_then_sum(details, ["lot", "bidder"], "factor", F.coalesce("weighted_score", "raw_score"))
    rows = summaries.filter("total_score IS NOT NULL").join(own, ["lot", "bidder"])
    return _row(rows, "P3-13", F.abs(F.col("calculated") - F.col("total_score")) > tolerance)


def deviation(details: DataFrame, rule_id: str = "P3-05", word: str = "") -> DataFrame:
    """P3-05, and P3-11 for technical factors."""
    rows = details.filter(F.contains("factor", F.lit(word)))
    return _row(scores.mean_deviation(rows, ["lot", "bidder", "factor"], "raw_score"), rule_id, F.col("warning"))


def price_regularity(openings: DataFrame, rule_id: str = "P3-12") -> DataFrame:
    return _row(scores.adjacent_gaps(openings, "lot", "bid_price"), rule_id, F.col("regular"))


def price_records(openings: DataFrame) -> DataFrame:
    """P2-09: opening records have a bidder and a price."""
    return _row(openings, "P2-09", (F.col("bidder") == "") | F.col("bid_price").isNull())


def committee(details: DataFrame, method: str) -> DataFrame:
    """P2-11: the number of experts is odd and large enough for the method."""
    least = 5 if method in ("公开招标", "邀请招标") else 3
    n = F.count_distinct(F.nullif("expert", F.lit("")))
    return details.agg(n.alias("n")).select(F.lit("P2-11").alias("rule_id"), status((F.col("n") < least) | (F.col("n") % 2 == 0), F.col("n") > 0).alias("status"))


def candidate_ranks(rankings: DataFrame, summaries: DataFrame, rule_id: str = "P1-04") -> DataFrame:
    """P1-04 and P1-06: candidates against ranks by total, each bidder once."""
    best = summaries.filter("total_score IS NOT NULL").groupBy("bidder").agg(F.max("total_score").alias("total_score"))
    rows = scores.global_rank(best, [F.desc("total_score"), F.asc("bidder")], "expected_rank").join(rankings.filter("rank IS NOT NULL").select("bidder", "rank"), "bidder")
    return _row(rows, rule_id, F.col("rank") != F.col("expected_rank"))


def report_sections(reports: DataFrame, text: str = "text") -> DataFrame:
    """P1-09 and the completeness check: per report the groups of content of which no word occurs."""
    groups = F.array(*[F.when(~contains_any(text, words), F.lit(name)) for name, words in K.REPORT_SECTIONS])
    return reports.withColumn("missing", F.filter(groups, lambda g: g.isNotNull()))


def matrix(spark: SparkSession, executed: DataFrame, issues: DataFrame | None = None, planned: list[str] | None = None) -> DataFrame:
    """(rule_id, status) of all rules. Inactive rules are disabled, those not planned not applicable; issues matched to a
    rule (rule_id, requires_human_review) come before executors; a rule without data is never passed.
    """
    out = catalogue(spark).join(F.broadcast(executed.withColumnRenamed("status", "done")), "rule_id", "left")  # a row for each rule
    plan = F.lit(True) if planned is None else F.col("rule_id").isin(*planned)
    state = F.when(~F.col("active"), "disabled").when(~plan, "not_applicable")
    if issues is not None:
        out = out.join(issues.groupBy("rule_id").agg(F.max("requires_human_review").alias("review")), "rule_id", "left")
        state = state.when(F.col("review"), "human_review").when(~F.col("review"), "confirmed_issue")
    return out.select("rule_id", "group_code", state.otherwise(F.coalesce("done", F.lit("insufficient_data"))).alias("status"))
