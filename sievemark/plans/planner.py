"""Which rules a task's documents call for, and which can run: facts of a task and needs of a rule as bit sets.

A fact is one bit. Documents' facts are or-ed to their task's, so no text is ever joined. A rule needs at least one fact of
each of its sets: those of its trigger for it to match, those of its input for it to run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..exprs import contains_any

# Words whose presence is a fact of a document, and the methods of procurement in the order they are sought.
MARKERS = {
    "lot": ("包编号", "包号", "标包", "分包"),
    "negotiation_report": ("谈判报告",),
    "unbalanced": ("工程量清单", "不平衡报价", "异常低价"),
    "recusal": ("评标委员会", "评审专家", "回避"),
    "sale": ("公告", "发售"),
    "opening": ("开标",),
    "committee": ("评标委员会", "评审委员会", "评委", "专家"),
    "qualification": ("资格审查",),
    "conformity": ("符合性审查",),
}
LOT_PATTERN = r"ZBDL\d+号-\d+|项目编号[^\n]*号-\d+"
METHODS = ("公开招标", "邀请招标", "竞争性谈判", "竞争性磋商", "询价", "单一来源")
NEGOTIATED = "谈判"
UNKNOWN_METHOD = "未识别"
# What triggers a conditional rule, and what the rules of a category read.
TRIGGERS = {"P1-01": ("lot", "lot_number"), "P1-12": ("negotiated", "negotiation_report"), "P3-06": ("unbalanced",), "P3-09": ("unbalanced",), "P2-10": ("recusal",)}
INPUTS = {
    "项目基本信息": ("document",), "评标结果与推荐": ("rankings", "summaries"), "报告签章与附件": ("report",), "招标公告与发售情况": ("sale",), "开标情况": ("opening", "openings"),
    "评标委员会组成": ("committee",), "资格审查": ("qualification",), "符合性审查": ("conformity",), "详细评审": ("details", "summaries", "openings"), "评审结果汇总": ("details", "summaries", "openings"),
}
CHECKS = {"compliance": K.COMPLIANCE, "data": K.DATA, "anomaly": K.ANOMALY}
PHASES = {
    "UC-05": ("P2-09", "P3-06", "P3-08", "P3-09", "P3-12", "P3-13", "P3-14", "P3-17", "P3-18"),
    "UC-06": ("P1-04", "P1-05", "P1-06", "P1-07", "P3-10"),
    "UC-07": ("P2-10", "P3-05", "P3-07", "P3-11"),
}
#: Facts that relations of a document give; each is a boolean column of ``docs``.
RECORDS = ("rankings", "summaries", "details", "openings", "report")


@dataclass(frozen=True)
class Vocabulary:
    """The words and pattern that make facts; others than the domain's may stand in for them."""

    markers: dict[str, tuple[str, ...]]
    lot_pattern: str = LOT_PATTERN
    methods: tuple[str, ...] = METHODS
    negotiated: str = NEGOTIATED

    def facts(self) -> list[str]:
        return ["document", *RECORDS, *self.markers, "lot_number", "negotiated", *(f"method {i}" for i in range(len(self.methods)))]

    def bits(self, names: tuple[str, ...]) -> int:
        at = self.facts()
        return sum(1 << at.index(n) for n in names)


DOMAIN = Vocabulary(MARKERS)


def document_facts(text: Column, vocabulary: Vocabulary = DOMAIN) -> Column:
    """A document's facts as a number."""
    v, found = vocabulary, {"document": F.lit(True)} | {r: F.coalesce(F.col(r), F.lit(False)) for r in RECORDS}
    found |= {name: contains_any(text, words) for name, words in v.markers.items()} | {"lot_number": text.rlike(v.lot_pattern)}
    found |= {f"method {i}": F.contains(text, F.lit(m)) for i, m in enumerate(v.methods)}
    return sum((F.when(F.coalesce(test, F.lit(False)), F.lit(v.bits((name,)))).otherwise(F.lit(0)) for name, test in found.items()), F.lit(0).cast("long"))


def task_facts(docs: DataFrame, tasks: DataFrame, vocabulary: Vocabulary = DOMAIN) -> DataFrame:
    """(task, method, method_source, facts) of every task.

    docs: task, text, the booleans of RECORDS, and method, a field that names the procurement method. tasks: task, and
    method as the system has it. The system's method counts before a field's before the first of ``methods`` that any
    text has. A task without documents has no facts.
    """
    v = vocabulary
    own = docs.select("task", document_facts(F.col("text"), v).alias("facts"), F.nullif(F.trim("method"), F.lit("")).alias("field"))
    held = own.groupBy("task").agg(F.bit_or("facts").alias("facts"), F.min("field").alias("field"))
    rows = tasks.select("task", F.nullif(F.trim("method"), F.lit("")).alias("system")).join(held, "task", "left").withColumn("facts", F.coalesce("facts", F.lit(0).cast("long")))
    read = F.lit(None).cast("string")
    for i in range(len(v.methods) - 1, -1, -1):
        read = F.when(F.col("facts").bitwiseAND(F.lit(v.bits((f"method {i}",)))) != 0, v.methods[i]).otherwise(read)
    rows = rows.withColumn("read", read).withColumn("method", F.coalesce("system", "field", "read", F.lit(UNKNOWN_METHOD)))
    source = F.when(F.col("system").isNotNull(), "system").when(F.col("field").isNotNull(), "field").when(F.col("read").isNotNull(), "text").otherwise("none")
    talks = F.when(F.contains("method", F.lit(v.negotiated)), F.lit(v.bits(("negotiated",)))).otherwise(F.lit(0))
    return rows.select("task", "method", source.alias("method_source"), F.col("facts").bitwiseOR(talks.cast("long")).alias("facts"))


def rule_needs(vocabulary: Vocabulary = DOMAIN) -> list[tuple[str, str, int, int]]:
    """(rule_id, owner, trigger, input) of the active rules; a trigger of 0 always holds, an input of 0 never."""
    return [(rule, owner, vocabulary.bits(TRIGGERS.get(rule, ()) if conditional else ()), vocabulary.bits(INPUTS.get(category, ()))) for rule, category, _, owner, _, active, conditional in K.RULES if active]


def plan_rules(tasks: DataFrame, check: str = "full", vocabulary: Vocabulary = DOMAIN) -> DataFrame:
    """(task, place, rule_id, owner, executable) for each rule that a task matches, in the catalogue's order.

    tasks: task, facts. ``check`` may name one kind of check alone. The catalogue is a literal, so nothing is joined.
    """
    wanted = CHECKS.get(check.strip().lower())
    needs = [(i, *n) for i, n in enumerate(rule_needs(vocabulary)) if not wanted or n[1] == wanted]
    one = lambda i, r, o, t, n: F.struct(F.lit(i).alias("place"), F.lit(r).alias("rule_id"), F.lit(o).alias("owner"), F.lit(t).cast("long").alias("trigger"), F.lit(n).cast("long").alias("needs"))
    rows = tasks.select("task", "facts", F.explode(F.array(*[one(*n) for n in needs])).alias("r")).select("task", "facts", "r.*")
    return rows.filter("trigger = 0 OR (facts & trigger) <> 0").select("task", "place", "rule_id", "owner", (F.col("facts").bitwiseAND(F.col("needs")) != 0).alias("executable"))


def plan_summary(tasks: DataFrame, check: str = "full", vocabulary: Vocabulary = DOMAIN) -> DataFrame:
    """(task, method, method_source, matched, executable, agents, phases) of every task.

    agents: the owners with a rule that can run, by their first one; phases: the matched rules of each phase of a review.
    """
    rules = plan_rules(tasks, check, vocabulary)
    runs = F.col("executable") & F.col("owner").isin(*CHECKS.values())
    ordered = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("place", "rule_id")))), lambda x: x["rule_id"])
    phases = F.create_map(F.lit("UC-04"), ordered(F.col("owner") == K.COMPLIANCE), *[x for name, ids in PHASES.items() for x in (F.lit(name), ordered(F.col("rule_id").isin(*ids)))])
    owners = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(runs, F.struct("place", "owner")))), lambda x: x["owner"]))  # at most one row a rule
    got = rules.groupBy("task").agg(F.count("*").alias("matched"), F.count_if("executable").alias("executable"), owners.alias("agents"), phases.alias("phases"))
    return tasks.select("task", "method", "method_source").join(got, "task", "left").withColumns({"matched": F.coalesce("matched", F.lit(0).cast("long")), "executable": F.coalesce("executable", F.lit(0).cast("long"))})



def issues_of_rules(issues: DataFrame, rules: DataFrame, matchers: dict[str, tuple[str, ...]]) -> DataFrame:
    """JOI-12: (issue_id, rule_id): findings of a rule's owner whose type or description has one of the rule's words.

    rules: rule_id, owner, item. An equi-join by owner; the few rules of an owner are a literal list each.
    """
    words = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for r, w in matchers.items() for x in (r, w)]) if matchers else F.create_map().cast("map<string,array<string>>")
    held = rules.select("rule_id", "owner", F.coalesce(words[F.col("rule_id")], F.array("item")).alias("words"))
    text = F.concat_ws(" ", F.col("issue_type"), F.col("description"))
    return issues.withColumn("said", text).join(F.broadcast(held), "owner").filter(F.exists("words", lambda w: F.contains(F.col("said"), w))).select("issue_id", "rule_id")
