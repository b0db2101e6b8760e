"""Rows of one key: what operators make of them on the way must not be all pairs."""

import pytest
from pyspark.sql import functions as F

from sievemark.operators import gate, links, quotes, text
from sievemark.plans import executors as X
from sievemark.plans import lifecycle

N = 300


@pytest.fixture
def most_rows(spark):
    """The rows of a DataFrame, and the most that any node of its plan made."""

    def walk(node):
        made = node.metrics().get("numOutputRows")
        own = made.get().value() if made.isDefined() else 0
        return max([own, *[walk(node.children().apply(i)) for i in range(node.children().size())]])

    def run(df):
        rows = df.collect()
        return rows, walk(df._jdf.queryExecution().executedPlan())

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield run
    spark.conf.set("spark.sql.adaptive.enabled", before)


def bids(spark):
    openings = spark.range(N).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("doc"), F.when(F.col("id") % 2 == 0, "甲 公司").otherwise("乙公司").alias("bidder"))
    docs = spark.range(N).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("doc"), F.when(F.col("id") % 2 == 0, X.REPORT).otherwise(X.OPENING).alias("subtype"))
    return openings, docs


def test_bidder_difference(spark, most_rows):
    rows, most = most_rows(X.bidder_difference(*bids(spark)))
    assert sorted(map(tuple, rows)) == sorted([("甲公司", X.REPORT), ("乙公司", X.OPENING)])
    assert most <= N


def test_bidder_sets(spark, most_rows):
    rows, most = most_rows(X.bidder_sets(*bids(spark)))
    assert [tuple(r) for r in rows] == [("P2-03", "human_review")]
    assert most <= N


def findings(spark, rows):
    return spark.createDataFrame(rows, "seq int, source_file string, source_location string, issue_type string, description string, risk_level string, requires_human_review boolean, evidence array<string>")


def test_review_of_equal_quotes(spark, most_rows, monkeypatch):
    """Many findings with one quote, many equal texts of one file: they meet as one quote."""
    made = []
    find = lifecycle.find_quotes
    monkeypatch.setattr(lifecycle, "find_quotes", lambda q, t: made.append(find(q, t)) or made[-1])
    issues = findings(spark, [(i, "f", str(i), "t", "d", "低", True, ["q" if i % 2 else "zz"]) for i in range(N)])
    docs = spark.range(N).select(F.lit("f").alias("source_file"), F.lit("some q here").alias("text"))
    got = {r["seq"]: r["reason"] for r in lifecycle.review_reasons(issues, docs).collect()}
    assert got == {i: "" if i % 2 else "unlocated" for i in range(N)}
    assert sum(d.count() for d in made) <= N


def test_review_of_whole_texts(spark, monkeypatch):
    """Quotes that are whole texts aren't searched for; all others are, each in its file or, where that is unknown, in all."""
    asked = []
    find = lifecycle.find_quotes
    monkeypatch.setattr(lifecycle, "find_quotes", lambda q, t: asked.extend(r["quote"] for r in q.collect()) or find(q, t))
    docs = spark.createDataFrame([("f", "one two three"), ("f", "one two three"), ("g", "four five"), (None, "six"), ("h", ""), ("h", None)], "source_file string, text string")
    rows = [("f", ["one two three"], ""), ("g", ["one two three"], "unlocated"), (None, ["one two three", "six"], ""), ("no such", ["four five"], ""), ("f", ["two", ""], ""), ("g", ["two"], "unlocated"), ("h", ["five"], ""), ("h", ["seven"], "unlocated"), ("f", [], ""), ("f", None, "")]
    issues = findings(spark, [(i, f, str(i), "t", "d", "低", True, e) for i, (f, e, _) in enumerate(rows)])
    got = {r["seq"]: r["reason"] for r in lifecycle.review_reasons(issues, docs).collect()}
    assert got == {i: r for i, (*_, r) in enumerate(rows)}
    assert sorted(asked) == ["five", "one two three", "seven", "two"]


def test_quotes_of_all_kinds_read_texts_together(spark, most_rows):
    """Short quotes and such with inner words: texts are read once for the anchors' counts and once for the anchors."""
    asked = spark.createDataFrame([(1, "q"), (2, "zz"), (3, "a b"), (4, "some q here"), (5, "no q"), (6, "q h")], "qid int, quote string")
    texts = spark.range(N).select("id", F.when(F.col("id") % 2 == 0, "some q here").otherwise("a b").alias("text"))
    found = quotes.find_quotes(asked, texts)
    got, most = most_rows(found)
    assert sorted(map(tuple, got)) == sorted([(1, i, 5) for i in range(0, N, 2)] + [(4, i, 0) for i in range(0, N, 2)] + [(6, i, 5) for i in range(0, N, 2)] + [(3, i, 0) for i in range(1, N, 2)])
    assert found._jdf.queryExecution().executedPlan().toString().count("Range (") == 2


def test_findings_of_one_quote_are_told_by_it(spark, monkeypatch):
    """What is sought and what is lost are quotes of files, however many findings give them."""
    met = []
    unmet = lifecycle._unmet
    monkeypatch.setattr(lifecycle, "_unmet", lambda a, h: met.append(a.count()) or unmet(a, h))
    issues = findings(spark, [(i, ("f", "g", None)[i % 3], str(i), "t", "d", "低", True, ["q", "zz", "q"][: 1 + i % 2]) for i in range(N)])
    docs = spark.createDataFrame([("f", "some q here"), ("h", "zz")], "source_file string, text string")
    got = {r["seq"]: r["reason"] for r in lifecycle.review_reasons(issues, docs).collect()}
    assert got == {i: "unlocated" if i % 3 == 0 and i % 2 else "" for i in range(N)}
    assert met and max(met) <= 6


def test_verbatim(spark, most_rows):
    rows = [(1, "f", ["q"]), (2, "f", ["zz"]), (3, "g", ["q"]), (4, "f", [])]
    issues = spark.createDataFrame(rows, "seq int, source_file string, evidence array<string>")
    texts = spark.range(N).select(F.lit("f").alias("source_file"), F.when(F.col("id") % 3 == 0, "no").otherwise("some q here").alias("text"))
    got, _ = most_rows(lifecycle.verbatim(issues, texts, "source_file", "text", "evidence").select("seq"))
    assert [r["seq"] for r in got] == [1] * (2 * N // 3)
    silent = issues.filter("seq = 2").crossJoin(spark.range(N)).select("source_file", "evidence", "seq")
    got, most = most_rows(lifecycle.verbatim(silent, texts, "source_file", "text", "evidence"))
    assert not got and most <= 2 * N


def test_evidence_rows(spark, most_rows):
    """A row of the result for each pair, made from one pair of different texts."""
    records = spark.range(3).select(F.col("id"), F.lit("d").alias("doc"), F.lit("s").alias("sheet"), F.lit(2).alias("row_no"))
    cells = spark.range(N).select(F.lit("d").alias("doc"), F.lit("s").alias("sheet"), F.lit(2).alias("row_no"), F.array(F.lit("甲"), F.lit(" "), F.when(F.col("id") % 2 == 0, "1").otherwise("2")).alias("cells"))
    got, _ = most_rows(X.evidence_rows(records, cells))
    assert sorted(map(tuple, got)) == sorted((i, "d", "s", 2, f"甲 | {1 + k % 2}") for i in range(3) for k in range(N))
    joins = X.evidence_rows(records, cells)._jdf.queryExecution().optimizedPlan().toString()
    assert joins.index("Generate") < joins.index("Join")  # copies are made after the join


def test_repeated(spark):
    rows = spark.createDataFrame([("a", 1), ("b", links.RUN), ("c", 2 * links.RUN + 1)], "x string, n long")
    assert {r["x"]: r["count"] for r in links.repeated(rows, "n").groupBy("x").count().collect()} == {"a": 1, "b": links.RUN, "c": 2 * links.RUN + 1}


def test_page_for_offset(spark, most_rows):
    pages = spark.createDataFrame([("a", p, n) for p, n in ((1, 10), (1, 3), (2, 0), (3, None), (4, 5))] + [("b", None, 4), (None, 1, 9)], "doc string, page int, n_chars int")
    offsets = spark.createDataFrame([("a", o) for o in (0, 14, 15, 16, 21, 22, None, 0)] + [("b", 4), ("b", 5), (None, 0), ("c", 0)], "doc string, offset int")
    got, _ = most_rows(X.page_for_offset(offsets, pages))
    # page 1 stops at 15, 2 and 3 at 16, 4 at 22
    assert sorted(map(tuple, got), key=str) == sorted([("a", 0, 1), ("a", 14, 1), ("a", 15, 2), ("a", 16, 4), ("a", 21, 4), ("b", 4, None)], key=str)
    many = spark.range(N).select(F.lit("a").alias("doc"), F.col("id").cast("int").alias("page"), F.lit(1).alias("n_chars"))
    got, most = most_rows(X.page_for_offset(spark.range(N).select(F.lit("a").alias("doc"), F.col("id").cast("int").alias("offset")), many))
    assert sorted(map(tuple, got)) == [("a", i, i // 2) for i in range(N)]
    assert most <= 2 * N


def test_keyword_lines_are_cut_only(spark):
    line = "License " + "x" * 231 + " tail"
    rows = spark.createDataFrame([(f"  {line}  \nnone\n{line}\nLicense",)], "text string")
    assert rows.select(text.keyword_lines("text", ("License",)).alias("k")).first()["k"] == [line[:240], "License"]


def test_price_sums_match_once(spark):
    """A text is matched once for its parts, whatever is then asked of them."""
    rows = [(1, "甲报价为人民币1,000.50元；乙报价：人民币2万元；乙报价：人民币2万元；预算报价为人民币5元；限价报价为人民币6元。\n投标总价为人民币3万元。"), (2, "甲报价为人民币1元；乙报价为人民币2 元。投标总价：人民币3元"), (3, "甲报价为人民币1元。投标总价为人民币2元"), (4, "甲报价为人民币1元；乙报价为人民币5元"), (5, None)]
    df = gate.price_sums(spark.createDataFrame(rows, "doc int, text string"))
    assert [tuple(r) for r in df.collect()] == [(1, 21000.5, 30000.0, ["甲报价为人民币1,000.50元", "乙报价：人民币2万元", "投标总价为人民币3万元"])]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
