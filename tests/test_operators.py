"""Reference operators on small fixtures: values, quirks, order and partition invariance."""

from pyspark.sql import functions as F

from sievemark import constants as K
from sievemark.exprs import clean_text, issue_id, line_number, money_values, money_yuan, number
from sievemark.operators import links, scores, text
from sievemark.plans import lifecycle, retrieval, rules
from sievemark.streaming.events import latest, live_entries, tumbling


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression("v").alias("x")).first()["x"]


def test_clean_text(spark):
    assert one(spark, "\x00a \t b\r\n\r\n\r\n\r\n c　\r", clean_text) == "a b\n\nc"
    assert one(spark, "", clean_text) == ""


def test_unicode_white_space_and_digits(spark):
    assert one(spark, "　１． 标题", lambda c: text.strip(c)) == "１． 标题"
    assert one(spark, "预算１２万元 和 30元", money_values) == ["１２万元", "30元"]


def test_numbers_and_money(spark):
    assert one(spark, "-1,234.5元", number) == -1234.5
    assert one(spark, "无", number) is None
    assert one(spark, "1.5亿元", money_yuan) == 1.5e8


def test_line_number(spark):
    row = spark.createDataFrame([("a\nb\nc",)], "v string").select(line_number("v", F.lit(2)).alias("x")).first()
    assert row["x"] == 2


def test_keyword_lines_limit_before_distinct(spark):
    body = "x唯一\nx唯一\ny唯一\nz唯一"
    assert one(spark, body, lambda c: text.keyword_lines(c, ("唯一",), 3)) == ["x唯一", "y唯一"]


def test_sections(spark):
    d = spark.createDataFrame([("d", "封面\n第一章 总则\n内容\n1. 投标人应当提交。\n1.1 范围\n细则")], "doc string, text string")
    got = [(r["title"], r["level"], r["line_start"], r["content"]) for r in text.sections(d, "doc", "text").orderBy("section_no").collect()]
    assert got == [("文档正文", 1, 1, "封面"), ("第一章 总则", 1, 2, "内容\n1. 投标人应当提交。"), ("1.1 范围", 2, 5, "细则")]


def test_chunks_match_the_loop(spark):
    for n in (1, 1199, 1200, 1201, 2279, 2280, 2281, 5000):
        body = "".join(chr(97 + i % 26) for i in range(n))
        want, start = [], 0
        while start < n:
            want.append(body[start : start + 1200])
            if start + 1200 >= n:
                break
            start += 1080
        got = text.chunks(spark.createDataFrame([(1, body)], "doc int, text string"), "doc", F.lit(1), "text").orderBy("part").collect()
        assert [r["content"] for r in got] == want


def test_greedy_chunks(spark):
    d = spark.createDataFrame([(1, "aaaa\nbbbb\ncccc\ndddd")], "doc int, text string")
    assert [r["content"] for r in text.greedy_chunks(d, "doc", "text", 9, 2).orderBy("chunk_no").collect()] == ["aaaa\nbbbb", "bb\ncccc", "cc\ndddd"]


def test_key_fields_skip_placeholders(spark):
    d = spark.createDataFrame([(1, "项目编号：____\n采购编号：ZC-1\n项目名称：某系统\n预算：120万元")], "doc int, text string")
    got = {r["field"]: r["value"] for r in text.key_fields(d, "doc", "text").collect()}
    assert got == {"project_id": "ZC-1", "project_name": "某系统", "budget": "120万元"}


def test_text_records(spark):
    d = spark.createDataFrame([(1, "评标报告", "投标人：甲公司，废标原因：未盖章\n第二中标候选人：乙公司\n评审意见：同意"), (2, "采购文件", "有下列情形的废标")], "doc int, subtype string, text string")
    got = {(r["doc"], r["kind"], r["bidder"], r["rank"], r["detail"]) for r in text.text_records(d, "doc", "subtype", "text").collect()}
    assert got == {(1, "rejection", "甲公司", None, "未盖章"), (1, "candidate", "乙公司", 2, "第二中标候选人：乙公司"), (1, "opinion", "", None, "同意"), (2, "invalid_bid_clause", "", None, "有下列情形的废标")}


def test_citations_and_seals(spark):
    assert [tuple(x) for x in one(spark, "依据《招标投标法》第三十三条和《招标投标法》第三十三条", text.legal_citations)] == [("招标投标法", "第三十三条")]
    d = spark.createDataFrame([("甲公司公章", ["甲公司"]), ("乙", ["甲公司"]), ("", ["甲公司"])], "s string, e array<string>")
    assert [r[0] for r in d.select(text.seal_matches("s", "e")).collect()] == [True, False, None]


def test_expert_deviation_fixture(spark):
    d = spark.createDataFrame([("A", 36.0), ("B", 35.0), ("C", 12.0)], "expert string, raw double").withColumns({"k": F.lit("x"), "m": F.lit(40.0)})
    assert {r["expert"]: r["deviation"] for r in scores.leave_one_out(d, ["k"], "raw", "m").collect()} == {"A": 12.5, "B": 11.0, "C": 23.5}


def test_progression_against_brute_force(spark):
    prices = [9.23, 9.6, 9.8, 10.0, 3.0, 5.0, 7.0]
    rows = spark.createDataFrame([("p", p) for p in prices * 2], "lot string, price double").repartition(5)
    got = scores.price_progression(rows, "lot", "price").first()
    cents = sorted({round(p * 100) for p in prices})
    best = max(((x, -y) for x in cents for y in cents if y > x and 2 * y - x in cents))
    assert (got["first_cents"], -got["middle_cents"]) == best


def test_similar_documents(spark):
    base = [f"这是一条用于测试相似度的足够长的独特内容行编号{i}一二三四五六七八" for i in range(3)]
    common = "这是所有文件都有的一条模板行因此不应被视为独特内容一二三四五六七八九"
    docs = spark.createDataFrame([("1", common), ("2", "\n".join([common, *base])), ("3", "\n".join([*base, common])), ("4", common)], "doc string, text string")
    got = links.similar_documents(docs, "doc", "text").collect()
    assert [(r["a"], r["b"], r["n_shared"]) for r in got] == [("2", "3", 3)]
    assert links.similar_documents(docs.limit(0), "doc", "text").count() == 0


def test_search_scores_and_ties(spark):
    chunks = spark.createDataFrame([("c1", "最高投标限价为一百万元", "价格", 1.0, False), ("c3", "投标人资格要求", "资格", 1.0, False)], "chunk_id string, content string, section string, confidence double, requires_human_review boolean")
    got = retrieval.search(chunks, "最高投标限价").collect()
    assert got[0]["chunk_id"] == "c1" and got[0]["score"] == 1.0
    assert retrieval.search(chunks, " ").count() == 0


def test_issue_id_and_review(spark):
    row = spark.createDataFrame([("a", ["q"])], "p string, e array<string>").select(issue_id("p", evidence="e").alias("i")).first()
    import hashlib

    assert row["i"] == "I" + hashlib.sha256(b"a|q").hexdigest()[:12]
    issues = spark.createDataFrame([(1, "a", "f", "l", "t", "d", "高", True, ["q"]), (2, "a", "f", "l", "t", "d", "高", True, ["q"]), (3, "a", "f", "l", "u", "d", "高", False, ["q"]), (4, "a", "f", "l", "v", "d", "中", True, ["zz"])], "seq int, owner string, source_file string, source_location string, issue_type string, description string, risk_level string, requires_human_review boolean, evidence array<string>")
    docs = spark.createDataFrame([("f", "text with q")], "source_file string, text string")
    assert {r["seq"]: r["reason"] for r in lifecycle.review_reasons(issues, docs).collect()} == {1: "", 2: "duplicate", 3: "unflagged", 4: "unlocated"}


def test_rule_matrix_without_data(spark):
    got = {r["status"]: r["count"] for r in rules.matrix(spark, spark.createDataFrame([], "rule_id string, status string")).groupBy("status").count().collect()}
    assert got == {"insufficient_data": 39, "disabled": 2}
    assert rules.catalogue(spark).count() == len(K.RULES) == 41


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", 7, "a", 1.0), (2, "2024-01-01 00:50:00", 7, "a", 2.0), (3, "2024-01-01 01:10:00", 7, "b", 4.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert tumbling(rows, "1 hour").count() == 2
    assert latest(rows, "user_id").first()["event_type"] == "b"
    rows.write.parquet(str(tmp_path / "in"))
    stream = tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 hour")
    q = stream.writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM win").first()["n"] == 3
    cache = spark.createDataFrame([("k", "1", "2024-01-01 00:00:00", "old"), ("k", "1", "2024-01-02 00:00:00", "new"), ("x", "1", "2023-01-01 00:00:00", "gone")], "key string, version string, created_at string, value string").withColumn("created_at", F.to_timestamp("created_at"))
    assert [r["value"] for r in live_entries(cache, "2024-01-02 00:00:01", 604_800).collect()] == ["new"]
    assert live_entries(cache, "2024-01-02 00:00:01", -1).count() == 2
