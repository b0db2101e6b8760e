"""A review in stages: cut anywhere it gives the same rows, computes nothing twice, waits for people and goes on."""

import pytest
from pyspark.sql import functions as F

from sievemark import storage
from sievemark.plans import review as R
from sievemark.plans.stages import Stage, StagedRun

DOCS = [(1, "a.pdf", "某条 License  here\r\n第二行 password=abc"), (2, "a.pdf", "某条 License here\n其他很长的一行文字，用来使正文超过二十个字符。"), (3, "b.pdf", None), (4, None, "token: x token: y 足够长的正文足够长的正文足够长的正文"), (3, "b.pdf", None)]
WORDS, PATTERN = ("License",), "(?i)(?:password|token)\\s*[:=]\\s*\\w+"
NAMES = [s.name for s in R.stages(WORDS, PATTERN)]


@pytest.fixture
def documents(spark):
    return spark.createDataFrame(DOCS, "document_id int, file_name string, text string")


def decisions(spark, outcome):
    rows = R.pending(outcome).select("issue_id", F.size("evidence").alias("n")).collect()
    return spark.createDataFrame([(i, r["issue_id"], "正确" if r["n"] > 1 else "误判", "") for i, r in enumerate(rows)] + [(99, None, "漏判", "另有问题")], "seq int, issue_id string, decision string, corrected_text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_waits_and_goes_on(spark, documents):
    root = storage.fresh(spark, "review")
    first = R.run_review(spark, root, documents, WORDS, PATTERN)
    assert (first.state, first.waits_for, first.computed) == ("waiting", "decisions", NAMES[:-2])
    issues = {(r["issue_type"], r["source_file"]): r for r in first.tables["evidenced"].collect()}
    assert set(issues) == {("限制性条款", "a.pdf"), ("敏感信息", "a.pdf"), ("敏感信息", ""), ("文本不可读", "b.pdf")} or ("敏感信息", "文档4") in issues
    line = issues["限制性条款", "a.pdf"]
    assert line["evidence"] == ["某条 License here"] and [r["document_id"] for r in line["evidence_refs"]] == [1, 2]
    again = R.run_review(spark, root, documents, WORDS, PATTERN)
    assert again.state == "waiting" and again.computed == []
    last = R.run_review(spark, root, documents, WORDS, PATTERN, decisions(spark, first))
    assert (last.state, last.computed) == ("done", ["decided", "summary"])
    got = {(r["issue_type"], r["final_status"]): r["n"] for r in last.tables["summary"].collect()}
    assert got == {("限制性条款", "confirmed_issue"): 1, ("文本不可读", "confirmed_issue"): 1, ("敏感信息", "normal"): 1, ("敏感信息", "confirmed_issue"): 1, ("漏判", "confirmed_issue"): 1}
    other = decisions(spark, first).withColumn("decision", F.lit("误判"))  # decisions count once
    assert R.run_review(spark, root, documents, WORDS, PATTERN, other).computed == []


def test_cut_between_any_two_stages(spark, documents):
    whole_root = storage.fresh(spark, "review")
    waiting = R.run_review(spark, whole_root, documents, WORDS, PATTERN)
    decided = decisions(spark, waiting)
    want = rows(R.run_review(spark, whole_root, documents, WORDS, PATTERN, decided).tables["summary"])
    for cut in NAMES[::2]:
        root = storage.fresh(spark, "review")
        run = StagedRun(spark, root, R.stages(WORDS, PATTERN), {"documents": documents})
        run.hand_in("decisions", decided)
        before = run.run(until=cut).computed
        out = StagedRun(spark, root, R.stages(WORDS, PATTERN), {"documents": documents}).run()
        assert before + out.computed == NAMES and rows(out.tables["summary"]) == want


def test_failed_stage_starts_anew_and_versions(spark):
    root, calls, broken = storage.fresh(spark, "review"), [], [True]

    def second(t):
        calls.append("b")
        out = t["a"].withColumn("y", F.col("x") * 2)
        return out.withColumn("y", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("y"))) if broken[0] else out

    stages = [Stage("a", lambda t: (calls.append("a"), spark.range(5).withColumnRenamed("id", "x"))[1]), Stage("b", second)]
    with pytest.raises(Exception, match="lost"):
        StagedRun(spark, root, stages, {}).run()
    broken[0] = False
    assert StagedRun(spark, root, stages, {}).committed("b") is None
    out = StagedRun(spark, root, stages, {}).run()
    assert calls == ["a", "b", "b"] and out.computed == ["b"] and rows(out.tables["b"]) == [(i, 2 * i) for i in range(5)]
    assert StagedRun(spark, root, stages, {}).run().computed == []
    assert StagedRun(spark, root, stages, {}, version="2").run().computed == ["a", "b"]
    assert StagedRun(spark, root, [Stage("new", lambda t: spark.range(1)), *stages], {}, version="2").run().computed == ["new", "a", "b"]
