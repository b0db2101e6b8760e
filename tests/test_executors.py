"""The filled rule matrix, and executors on relations without rows."""

from sievemark.plans import check_queries as Q
from pyspark.sql import functions as F

from sievemark.plans import executors as X
from sievemark.plans import rules
from sievemark.plans.fixture_queries import frame


def relations(spark, empty=False):
    out = {k: frame(spark, r) for k, r in Q.ALL.items()}
    out = {k: d.limit(0) if empty else d for k, d in out.items()}
    return out | {"tables": Q.tables(out)}


def test_matrix_from_executors(spark):
    done = X.execute(relations(spark)).collect()
    assert len({r["rule_id"] for r in done}) == len(done) == 24
    states = {r["rule_id"]: r["status"] for r in done}
    assert {k for k, v in states.items() if v == "passed"} == {"P1-01", "P1-02", "P1-08", "P1-10", "P2-04", "P2-06", "P2-07", "P2-08", "P3-01", "P3-03", "P3-04"}
    assert states["P1-03"] == states["P1-05"] == states["P2-02"] == states["P3-02"] == "human_review"
    matrix = {r["rule_id"]: r["status"] for r in rules.matrix(spark, X.execute(relations(spark))).collect()}
    assert len(matrix) == 41 and matrix["P1-01"] == "passed" and matrix["P3-15"] == matrix["P3-16"] == "disabled"


def test_rules_ask_a_relation_together(spark):
    """Documents are read for what all rules ask of them, for their dates, and for their kinds; other relations once or twice."""
    docs = spark.range(6).select(F.col("id").cast("int").alias("seq"), F.concat(F.lit("d"), F.col("id")).alias("doc"), F.lit(X.REPORT).alias("subtype"), F.lit("开标时间：2026年4月2日9:30").alias("text"))
    openings = spark.range(6, 9).select(F.concat(F.lit("d"), F.col("id")).alias("doc"), F.lit("甲公司").alias("bidder"), F.lit(1.0).alias("price"))
    done = X.execute(relations(spark, empty=True) | {"docs": docs, "openings": openings})
    got = {r["rule_id"]: r["status"] for r in done.collect()}
    assert got["P2-08"] == "passed" and got["P1-11"] == got["P1-07"] == "human_review" and got["P2-02"] == got["P2-03"] == "insufficient_data"
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 6") <= 3 and plan.count("Range (6, 9") <= 2


def test_equal_values_are_normalised_once(spark):
    """What Python normalises are distinct values: it comes after their grouping."""
    names = spark.createDataFrame([("a", "项目名称：ＡＢ工程第3包"), ("b", "AB工程第3包"), ("c", "1. 总则"), ("d", " "), ("e", None)], "source string, value string")
    ids = spark.createDataFrame([("a", "ZC－1", ""), ("b", "zc-1", ""), ("b", "zc-1", ""), ("c", "　", ""), ("d", None, "")], "source string, value string, raw_text string")
    for df in (X.same_names(names), X.same_ids(ids)):
        assert df.first()["status"] == "passed"
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.rindex("ArrowEvalPython") < plan.rindex("Aggregate")  # the plan begins with its end
    assert X.same_ids(ids.filter("source IN ('a', 'c')")).first()["status"] == "insufficient_data"


def test_rules_without_data(spark):
    assert {r["status"] for r in X.execute(relations(spark, empty=True)).collect()} == {"insufficient_data"}


def test_deadline_in_its_own_section(spark):
    docs = spark.createDataFrame([(1, "d", "招标文件", "投标截止时间和地点\n投标截止及开标时间、地点\n1. 时间：2026年4月2日 9:30\n")], "seq int, doc string, subtype string, text string")
    assert X.stated_date(docs, "P2-04").first()["status"] == "passed"


def test_project_names(spark):
    row = spark.createDataFrame([("项目名称：ＡＢ 工程第３包。", "ｚｃ－１—２", None)], "a string, b string, c string")
    assert row.select(X.project_name("a"), X.project_id("b"), X.project_name("c")).first()[:] == ("AB工程第3包", "ZC-1-2", "")
