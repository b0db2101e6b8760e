"""The rule planner against plain sets of facts."""

import re

import pytest

from sievemark import constants as K
from sievemark.plans import planner as P

DOCS = "task string, text string, method string, rankings boolean, summaries boolean, details boolean, openings boolean, report boolean"
ROWS = [
    ("a", "公开招标公告。包号：1。开标一览", "", False, False, False, False, False),
    ("a", "评标委员会由专家组成", None, True, None, True, False, True),
    ("b", "谈判报告 资格审查 工程量清单", "", False, False, False, True, False),
    ("c", "项目编号：甲号-12\n符合性审查", " 竞争性谈判 ", False, False, False, False, False),
    ("c", "邀请招标", "询价", False, True, False, False, False),
    ("d", None, None, None, None, None, None, None),
]
TASKS = [("a", ""), ("b", None), ("c", ""), ("d", "单一来源"), ("none", "")]


def plain(task, system, check):
    docs = [r for r in ROWS if r[0] == task]
    text = "\n".join(r[1] or "" for r in docs)
    fields = sorted(r[2].strip() for r in docs if r[2] and r[2].strip())
    method = system or (fields[0] if fields else next((m for m in P.METHODS if m in text), P.UNKNOWN_METHOD))
    has = {n for n, words in P.MARKERS.items() if any(w in text for w in words)} | ({"document"} if docs else set())
    has |= {n for i, n in enumerate(("rankings", "summaries", "details", "openings", "report"), 3) if any(r[i] for r in docs)}
    has |= {"lot_number"} if re.search(P.LOT_PATTERN, text) else set()
    has |= {"negotiated"} if "谈判" in method else set()
    out = []
    for rule, category, _, owner, _, active, conditional in K.RULES:
        trigger = P.TRIGGERS.get(rule) if conditional else None
        if active and (not trigger or has & set(trigger)) and (check == "full" or owner == P.CHECKS[check]):
            out.append((rule, owner, bool(has & set(P.INPUTS[category]))))
    return method, out


@pytest.mark.parametrize("check", ["full", "compliance", "data", "anomaly"])
def test_plans_against_plain_sets(spark, check):
    tasks = P.task_facts(spark.createDataFrame(ROWS, DOCS).repartition(3), spark.createDataFrame(TASKS, "task string, method string"))
    rules = {}
    for r in sorted(P.plan_rules(tasks, check).collect(), key=lambda r: r["place"]):
        rules.setdefault(r["task"], []).append((r["rule_id"], r["owner"], r["executable"]))
    for r in P.plan_summary(tasks, check).collect():
        method, want = plain(r["task"], dict(TASKS)[r["task"]], check)
        assert rules.get(r["task"], []) == want and (r["method"], r["matched"], r["executable"]) == (method, len(want), sum(x[2] for x in want))
        assert r["agents"] == list(dict.fromkeys(o for _, o, ok in want if ok and o in P.CHECKS.values()))
        for name, ids in P.PHASES.items():
            assert r["phases"][name] == [x[0] for x in want if x[0] in ids]
        assert r["phases"]["UC-04"] == [x[0] for x in want if x[1] == K.COMPLIANCE]


def test_issues_meet_rules_of_their_owner(spark):
    issues = spark.createDataFrame([("i1", K.DATA, "投标报价", "报价缺失"), ("i2", K.COMPLIANCE, "投标报价", "x"), ("i3", K.DATA, "别的", None)], "issue_id string, owner string, issue_type string, description string")
    rules = spark.createDataFrame([("P2-09", K.DATA, "投标报价记录"), ("P1-02", K.COMPLIANCE, "x")], "rule_id string, owner string, item string")
    got = sorted(map(tuple, P.issues_of_rules(issues, rules, {"P2-09": ("报价", "价格")}).collect()))
    assert got == [("i1", "P2-09"), ("i2", "P1-02")]
