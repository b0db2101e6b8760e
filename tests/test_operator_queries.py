"""Queries that must run the operator they are named for, over all of its input."""

from sievemark.operators import text
from sievemark.plans import fixture_queries
from sievemark.plans.driver_queries import QUERIES


def test_document_sections_without_cap(spark, tmp_path):
    rows = [(1, "开头\n" + "\n".join(f"1.{i} 范围\n细则{i}" for i in range(1, 251))), (2, "plain"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["ext_01b_document_sections"](spark, str(tmp_path)).collect()]
    want = [(1, 1, "文档正文", 1, 1, "开头"), *((1, i + 1, f"1.{i} 范围", 2, 2 * i, f"细则{i}") for i in range(1, 251)), (2, 1, "文档正文", 1, 1, "plain")]
    assert sorted(got) == sorted(want)


def test_coverage_gap_by_containment(spark, monkeypatch):
    clauses = fixture_queries.frame(spark, fixture_queries.CLAUSES)  # the forms themselves; the queries derive rows of documents from them
    every = {r["id"] for r in fixture_queries.COVER(clauses).collect()}
    run = lambda: {r["id"] for r in fixture_queries.coverage_gap(clauses).collect()}
    assert run() == every - {1, 3}
    monkeypatch.setattr(fixture_queries, "RETURNED", ("evidence string", [("须提供指定品牌的服务器",), ("",)]))
    assert run() == every - {2}
    found = spark.createDataFrame([("甲必须在本市。",), ("乙",)], "evidence string")
    assert text.uncovered(found, found.limit(0)).count() == 2
