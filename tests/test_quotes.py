"""Many quotes in many texts against plain search, and the evidence of findings."""

import random

import pytest
from pyspark.sql import functions as F

from sievemark.operators import quotes as Q
from sievemark.plans import executors, lifecycle


def plain(quotes, texts):
    return sorted(((q, t, text.find(quote)) for q, quote in quotes if quote for t, text in texts if text and quote in text), key=str)


def found(spark, quotes, texts):
    q = spark.createDataFrame(quotes, "qid long, quote string").repartition(3)
    t = spark.createDataFrame([(*x, 1) for x in texts], "id long, text string, key int").repartition(3)
    return sorted(map(tuple, Q.find_quotes(q, t).collect()), key=str)


def corpus():
    draw = random.Random(5)
    words = ["alpha", "beta", "a", "I", "投标人", "注册地址", "100万元", "x-1", "O'Neil", "(第一章)", "é", "。", "，", "b.c"]
    texts = ["".join(draw.choice(words) + draw.choice([" ", "", "\n", "  "]) for _ in range(draw.randrange(0, 60))) for _ in range(60)]
    quotes = []
    for _ in range(400):
        t = draw.choice(texts)
        a, n = draw.randrange(len(t) + 1), draw.choice([1, 2, 3, 4, 6, 12, 30, 90])
        quotes.append(t[a : a + n] if draw.random() < 0.8 else t[a : a + n][::-1])
    return list(enumerate([*quotes, None, "", "投标", " ", "alpha beta gamma", "\n"])), list(enumerate([*texts, None, "", "alpha"]))


def test_find_quotes_against_plain_search(spark):
    quotes, texts = corpus()
    texts += texts[:5]  # repeated rows
    assert found(spark, quotes, texts) == plain(quotes, texts)
    assert found(spark, [], texts) == [] == found(spark, [(1, None)], texts) == found(spark, quotes, [])


def test_find_quotes_in_blocks(spark, monkeypatch):
    quotes, texts = corpus()
    monkeypatch.setattr(Q, "BLOCK_QUOTES", 50)
    monkeypatch.setattr(Q, "BROADCAST_KEYS", 10)
    assert found(spark, quotes, texts) == plain(quotes, texts)


def test_ten_thousand_quotes_without_a_nested_loop(spark):
    draw = random.Random(6)
    texts = [(i, " ".join(f"w{draw.randrange(3000)}" for _ in range(200))) for i in range(400)]
    quotes = []
    for i in range(12_000):
        t = draw.choice(texts)[1]
        a = draw.randrange(len(t))
        quotes.append((i, t[a : a + draw.randrange(20, 80)] if i % 3 else f"w{draw.randrange(3000)} w{draw.randrange(3000)} w{draw.randrange(3000)}"))
    out = Q.find_quotes(spark.createDataFrame(quotes, "qid long, quote string"), spark.createDataFrame(texts, "id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, out.collect()), key=str) == plain(quotes, texts)


CONTEXT = "file_name string, document_id string, place int, part string, ord int, section string, page int, content string"
TEXT = "投标人注册地址必须位于本市。\n投标报价为100万元。"


def contexts(spark):
    return spark.createDataFrame([
        ("真实招标文件.pdf", "F001", 1, "text", 0, "第二章 投标人资格要求", 18, "投标人注册地址必须位于本市。"),
        ("真实招标文件.pdf", "F001", 1, "text", 99, None, None, TEXT),
        ("真实招标文件.pdf", "F001", 1, "table", 0, None, 25, "100万元"),
        ("b.pdf", "F002", 2, "table", 0, "", 3, "投标人注册地址必须位于本市。"),
        ("b.pdf", "F002", 2, "metadata", 0, "entities", None, "甲公司"),
    ], CONTEXT)


ISSUE = "seq int, source_file string, source_location string, evidence array<string>"


@pytest.mark.parametrize("named", ["", "真实招标文件.pdf", "unknown.pdf", None])
def test_references_and_back_fill(spark, named):
    quote = "投标人注册地址必须位于本市。"
    issues = spark.createDataFrame([(1, named, "", [f" {quote} ", quote, ""]), (2, "", "kept", ["模型虚构的原文"]), (3, "", None, ["甲公司", quote]), (4, "", "", None)], ISSUE)
    got = {r["seq"]: r for r in lifecycle.enrich_evidence(issues, contexts(spark)).collect()}
    refs = got[1]["evidence_refs"]
    assert (refs[0]["document_id"], refs[0]["section"], refs[0]["page"], refs[0]["source_type"], refs[0]["position"]) == ("F001", "第二章 投标人资格要求", 18, "text", 0)
    assert [r["document_id"] for r in refs] == (["F001"] if named == "真实招标文件.pdf" else ["F001", "F002"])
    assert got[1]["source_file"] == (named or "真实招标文件.pdf") and got[1]["source_location"] == "第二章 投标人资格要求，第18页"
    assert got[1]["evidence"] == [f" {quote} ", quote, ""]
    assert got[2]["evidence_refs"] == [] and got[2]["source_location"] == "kept"
    assert [(r["document_id"], r["source_type"]) for r in got[3]["evidence_refs"]] == [("F002", "metadata"), ("F001", "text"), ("F002", "table")]
    assert (got[3]["source_file"], got[3]["source_location"]) == ("b.pdf", "entities") and got[4]["evidence_refs"] == []


def test_whole_text_where_no_section_has_the_quote(spark):
    issues = spark.createDataFrame([(1, "", "", ["本市。\n投标报价"])], ISSUE)
    (ref,) = lifecycle.enrich_evidence(issues, contexts(spark)).collect()[0]["evidence_refs"]
    assert (ref["source_type"], ref["section"], ref["page"], ref["position"]) == ("text", None, None, TEXT.find("本市。\n"))


def test_rejections_without_any_procurement_document(spark):
    rows = spark.createDataFrame([("r", "甲", "承诺", "第九条"), ("r", "乙", "", "")], "doc string, bidder string, reason string, cited string")
    none = rows.limit(0).select(F.col("doc").alias("text"))
    assert {r["why"] for r in executors.unsupported_rejections(rows, none, F.array("reason")).collect()} == {"no procurement document"}
    one = rows.limit(1).select(F.lit("按第九条执行").alias("text"))
    assert executors.unsupported_rejections(rows, one, F.array("reason")).count() == 0
