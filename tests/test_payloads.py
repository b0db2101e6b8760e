"""Answers as typed rows, and texts in segments, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievemark.operators import payloads as P
from sievemark.operators import segments as S

DEEP = '{"sections":' + "[" * 200 + "]" * 200 + "}"
PAYLOADS = {
    1: json.dumps({"sections": [{"title": " 一、总则 ", "level": 9, "content": " 正文 ", "page": 3}, {"title": ""}, {"level": 1}, "x", {"title": "t" * 300, "level": "2", "line_start": 7}, {"title": "bad", "level": "two"}, {"title": "none", "level": None}, {"title": 5}]}, ensure_ascii=False),
    2: json.dumps({"fields": {"a": "甲", "b": {"value": " 120万元 ", "raw_text": "预算：120万元", "confidence": 1.7, "requires_human_review": False}, "c": "暂无", "d": {"value": "x", "confidence": "high"}, "e": {"value": "____"}, "f": 3, "g": {"value": None}, "h": {"value": 12, "confidence": -1, "requires_human_review": 0}, "i": {"value": "N o n e"}}}, ensure_ascii=False),
    3: json.dumps({"fields": [{"field_name": "n", "value": "1"}, {"field_name": "n", "value": "2", "requires_human_review": "no"}, {"value": "3"}, "x"], "sections": {"title": "an object"}}),
    4: "{not json", 5: None, 6: "", 7: "[1,2]", 8: DEEP, 9: '"text"', 10: json.dumps({"sections": [{"title": f"s{i}"} for i in range(250)]}),
}


@pytest.fixture
def frame(spark):
    return P.parsed(spark.createDataFrame(list(PAYLOADS.items()), "id int, payload string"), "payload")


def test_broken_rows_are_kept_apart(spark):
    df = spark.createDataFrame(list(PAYLOADS.items()), "id int, payload string")
    assert sorted(r["id"] for r in P.broken_rows(df, "payload").collect()) == [4, 7, 9]


def test_sections(frame):
    got = sorted(tuple(r) for r in P.sections(frame, ["id"]).filter("id < 10").collect())
    assert got == [(1, 0, "一、总则", 6, "正文", 3, None), (1, 1, "t" * 200, 2, "", None, 7), (1, 2, "5", 1, "", None, None)]
    many = P.sections(frame, ["id"]).filter("id = 10").orderBy("pos").collect()
    assert [r["title"] for r in many] == [f"s{i}" for i in range(200)]


def test_fields(frame):
    got = {(r["id"], r["name"]): tuple(r)[2:] for r in P.fields(frame, ["id"]).collect()}
    assert got == {
        (2, "a"): ("甲", "", "", 0.7, True),
        (2, "b"): ("120万元", "预算：120万元", "", 1.0, False),
        (2, "h"): ("12", "", "", 0.0, False),
        (3, "n"): ("2", "", "", 0.7, True),
    }


def test_records_need_their_quote(spark):
    text = "第一中标候选人：甲公司。排名：二 乙公司。丙公司未响应。"
    payload = {"rejection_records": [{"bidder": "丙公司", "reason": "未响应", "evidence": "丙公司未响应。"}, {"bidder": "丁", "evidence": "没有的话"}, {"bidder": "戊", "evidence": " "}, 3], "evaluation_opinions": [{"author": "张", "opinion": "好", "evidence": "甲公司"}], "candidate_rankings": [{"bidder": "甲公司", "rank": 1, "evidence": "第一中标候选人：甲公司"}, {"bidder": "乙公司", "rank": "2", "lot": "包1", "evidence": "排名：二 乙公司"}, {"bidder": "丙", "rank": 3, "evidence": "丙公司"}, {"bidder": "x", "rank": 0, "evidence": "排名：二"}, {"bidder": "y", "rank": "n", "evidence": "排名：二"}]}
    df = P.parsed(spark.createDataFrame([(1, text, json.dumps(payload, ensure_ascii=False))], "id int, source string, payload string"), "payload")
    assert [tuple(r) for r in P.rejections(df, ["id"], "source").collect()] == [(1, 0, "丙公司", "未响应", "", "丙公司未响应。", False)]
    assert [tuple(r) for r in P.opinions(df, ["id"], "source").collect()] == [(1, 0, "张", "好", "甲公司")]
    assert sorted(tuple(r) for r in P.rankings(df, ["id"], "source").collect()) == [(1, 0, "甲公司", 1, "", "第一中标候选人：甲公司"), (1, 1, "乙公司", 2, "包1", "排名：二 乙公司")]
    cases = [("budget", "", "x", True), ("budget", "q", "a q b", True), ("budget", "q", "x", False), ("price_limit", "", "x", False), ("price_limit", "最高 限价 5", "最高 限价 5", True), ("price_limit", "预算 5", "预算 5", False)]
    got = spark.createDataFrame(cases, "n string, r string, s string, want boolean").select("want", P.evidence_matches(F.col("n"), F.col("r"), F.col("s")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def plain_split(text, size, overlap):
    """Greedy packing with an explicit list of lines and lengths."""
    out, group = [], []
    for line in [x.strip() for x in text.split("\n") if x.strip()]:
        if len(line) > size:
            out += ["\n".join(group)] if group else []
            group, start = [], 0
            while True:
                out.append(line[start : start + size])
                if start + size >= len(line):
                    break
                start += size - overlap
            continue
        if group and len("\n".join([*group, line])) > size:
            out.append("\n".join(group))
            tail = out[-1][-overlap:].lstrip() if overlap else ""
            group = [tail] if tail else []
        group.append(line)
    return out + (["\n".join(group)] if group else [])


def test_segments_against_a_plain_loop(spark):
    draw = random.Random(8)
    texts = ["\n".join("x" * draw.choice([0, 1, 5, 30, 60, 130]) + draw.choice(["", " ", "é  "]) + str(draw.randrange(99)) for _ in range(draw.randrange(0, 40))) for _ in range(60)] + [None, "", " \n ", "z" * 1000, "a\n" + "b" * 59 + "\nc"]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "id int, text string, tag string").repartition(3)
    for size, overlap in ((60, 10), (100, 0), (7, 6)):
        rows = sorted(tuple(r) for r in S.split_text(df, "text", size=size, overlap=overlap).select("id", "part", "content").collect())
        assert rows == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(plain_split(t or "", size, overlap))]
    whole = S.split_text(df, "text", size=200, overlap=20).select("id", "part", "content").collect()
    pieces = S.split_text(df, "text", size=200, overlap=20, floor=40).orderBy("id", "part", "half").collect()
    assert max(len(r["content"]) for r in pieces) <= 40
    joined = {}
    for r in pieces:
        joined[r["id"], r["part"]] = joined.get((r["id"], r["part"]), "") + r["content"]
    squeeze = lambda t: "".join(t.split())
    assert {k: squeeze(v) for k, v in joined.items()} == {(r["id"], r["part"]): squeeze(r["content"]) for r in whole}


def test_halves():
    assert S.halves("aaaa\nbbbb") == ("aaaa", "bbbb") and S.halves("a\nbbbbbbbb\nc") == ("a\nbbbbbbbb", "c")
    assert S.halves("abcdef") == ("abc", "def") and list(S.bisected("abc", 1)) == ["a", "b", "c"]
