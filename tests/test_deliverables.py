"""Workbooks written and read back, all or none; rule results with totals against plain counts."""

import io
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemark.plans import reports
from sievemark.sources import files, workbooks as W


def back(spark, path):
    rows = files.parse(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)).filter("kind = 'table'").collect()
    assert not spark.read.format("binaryFile").load(path).filter("path like '%_temporary%'").count()
    return rows


def issue(i, **more):
    return {"issue_id": f"I{i}", "risk_level": "高", "issue_type": "t", "description": f"行一\n{i}", "evidence": [f"e{i}", "f"], "basis": None, "source_location": "", "suggestion": "", "final_status": "passed"} | more


SCHEMA = "issue_id string, risk_level string, issue_type string, description string, evidence array<string>, basis string, source_location string, suggestion string, final_status string"


def frame(spark, issues, parts=3):
    return spark.createDataFrame([tuple(x[c] for c in W.COLUMNS["compliance"]) for x in issues], SCHEMA).repartition(parts)


def test_workbooks_read_back(spark, tmp_path):
    odd = ["<&>\"'", "_x0041_", "a\rb\tc", "\x01\x1f", "=1+1", "é😀"]
    path = str(tmp_path / "out")
    W.write_deliverable(frame(spark, [issue(i, issue_type=t) for i, t in enumerate(odd)]), "compliance", path, project_id="P&1", task_id="T")
    rows = back(spark, path)
    cover = [r["rows"] for r in rows if r["sheet"] == W.COVER]
    assert all(c[0] == ["合规问题清单"] and ["项目编号", "P&1"] in c and ["任务编号", "T"] in c for c in cover)
    assert sum(int(c[-1][1]) for c in cover) == len(odd)
    sheets = [r["rows"] for r in rows if r["sheet"] == W.SHEETS["compliance"]]
    assert all(s[0] == list(W.HEADERS["compliance"]) for s in sheets)
    assert {r[0]: (r[2], r[3], r[4]) for s in sheets for r in s[1:]} == {f"I{i}": (t.strip() if t.strip() else t.strip(), f"行一\n{i}", f"e{i}\nf") for i, t in enumerate(odd)}
    assert os.path.exists(f"{path}/_SUCCESS")


def test_overwrite_append_and_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    ids = lambda: sorted(r[0] for x in back(spark, path) if x["sheet"] != W.COVER for r in x["rows"][1:])
    W.write_deliverable(frame(spark, [issue(1), issue(2)]), "compliance", path)
    W.write_deliverable(frame(spark, [issue(3)]), "compliance", path, mode="append")
    assert ids() == ["I1", "I2", "I3"]
    W.write_deliverable(frame(spark, [issue(4)]), "compliance", path)
    assert ids() == ["I4"]
    W.write_deliverable(frame(spark, []), "compliance", path)
    assert [r for x in back(spark, path) if x["sheet"] != W.COVER for r in x["rows"][1:]] == [["—", "—", "本次未形成问题"]]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    W.write_deliverable(frame(spark, [issue(1)]), "compliance", path)
    before = sorted(os.listdir(path))
    many = frame(spark, [issue(i) for i in range(60)], parts=4)
    broken = many.withColumn("final_status", F.when(F.col("issue_id") == "I41", F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        W.write_deliverable(broken, "compliance", path)
    assert sorted(os.listdir(path)) == before
    with pytest.raises(Exception, match="columns|kind"):
        many.write.format(W.FORMAT).mode("append").option("kind", "parse").save(path)


def test_long_tables_go_on_in_more_sheets():
    out = io.BytesIO()
    assert W.write_workbook(out, iter([(i, "x") for i in range(10)]), ("a", "b"), "S", [("c",)], sheet_rows=4) == 10
    got = {r["sheet"]: r["rows"] for r in files.xlsx_records(out.getvalue()) if r["kind"] == "table"}
    assert list(got) == [W.COVER, "S", "S 2", "S 3", "S 4"]
    assert [r[0] for name in list(got)[1:] for r in got[name][1:]] == [str(i) for i in range(10)] and all(got[n][0] == ["a", "b"] for n in list(got)[1:])


def test_rules_summary(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), f"P{draw.randrange(1, 4)}-{draw.randrange(10, 19)}", draw.choice([*reports.STATUSES, "odd", None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "task string, rule_id string, status string")
    want = Counter()
    for task, rule, status in rows:
        for key in ((task or "", rule[:2]), (task or "", reports.ALL_GROUPS), (reports.ALL_TASKS, reports.ALL_GROUPS)):
            want[key, "total"] += 1
            want[key, "executed"] += status in reports.EXECUTED
            want[key, status] += 1
    out = reports.rules_summary(df)
    got = out.collect()
    assert len(got) == len({k for k, _ in want})
    for r in got:
        assert all(r[c] == want[(r["task"], r["group_code"]), c] for c in ("total", "executed", *reports.STATUSES))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # shown before and after planning anew
    assert reports.rules_summary(df.limit(0)).collect() == []


def test_rule_lines(spark):
    schema = "task string, rule_id string, category string, item string, risk_level string, status string, execution_evidence array<string>, missing_inputs array<string>, reason string"
    rows = [("t", "P1-01", "c", "i", "高", "passed", ["a", "", "b"], ["m"], "r"), ("t", "P1-02", "c", "i", "高", "insufficient_data", [], ["m"], "r"), ("t", "P2-01", "c", "i", "高", "human_review", None, None, "r"), ("t", "P2-02", "c", "i", "高", "other", None, None, None)]
    got = {r["rule_id"]: (r["group_code"], r["state"], r["detail"]) for r in reports.rule_lines(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"P1-01": ("P1", "通过", "a；b"), "P1-02": ("P1", "资料不足未执行", "m"), "P2-01": ("P2", "待人工复核", "r"), "P2-02": ("P2", "other", "无")}
