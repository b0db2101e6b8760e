"""The written term index: tasks apart, replaced one at a time, read by bucket; and search against a plain score."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark import storage
from sievemark.plans import retrieval as R

SCHEMA = "task string, chunk_id string, document_id string, content string, section string, page int, confidence double, requires_human_review boolean"
CHUNKS = [
    ("T001", "F1-s1-c1-abcd", "F1", "项目名称：某市政务信息化平台升级项目。最高投标限价100万元。", "项目基本信息", 1, 0.9, False),
    ("T001", "F1-s2-c1-efgh", "F1", "投标人应提交技术方案和服务响应方案。", "资格要求", 3, 0.9, True),
    ("T003", "F9-s1-c1-zzzz", "F9", "最高投标限价", "x", 1, 0.1, False),
]


@pytest.fixture
def index(spark):
    out = R.TermIndex(spark, f"t{random.randrange(10**9)}", storage.fresh(spark, "index"), buckets=16)
    yield out
    out.drop()


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def test_tasks_filters_and_pruning(spark, index):
    index.write(spark.createDataFrame(CHUNKS, SCHEMA))
    assert ids(index.search("T001", "最高投标限价", 5)) == ["F1-s1-c1-abcd"]
    assert ids(index.search("T001", "技术方案", where=F.col("document_id") == "F1")) == ["F1-s2-c1-efgh"]
    assert ids(index.search("T001", "技术方案", where=F.col("document_id") == "missing")) == []
    assert ids(index.search("T001", "最高投标限价", where=F.col("page") == 3)) == []
    assert ids(index.search("T002", "最高投标限价")) == [] == ids(index.search("T001", "  ")) == ids(index.search("T001", "x"))
    shown = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # else the plan prunes buckets, but doesn't say so
    spark.conf.set(shown, "false")
    try:
        plan = index.postings("T001", ["限价", "技术"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(shown)
    chosen = re.search(r"SelectedBucketsCount: (\d+) out of 16", plan)
    assert chosen and int(chosen[1]) <= 2 and "PartitionFilters: [isnotnull(task" in plan


def test_one_task_is_replaced(spark, index):
    index.write(spark.createDataFrame(CHUNKS, SCHEMA))
    other = sorted(spark.table(index.terms).filter("task = 'T003'").inputFiles())
    new = [("T001", "N1", "F1", "最高投标限价200万元", "s", 1, 0.5, False), ("T004", "N4", "F4", "另有技术方案", "s", 1, 0.5, False)]
    index.write(spark.createDataFrame(new, SCHEMA))
    assert ids(index.search("T001", "最高投标限价")) == ["N1"] and ids(index.search("T004", "技术方案")) == ["N4"]
    assert ids(index.search("T003", "最高投标限价")) == ["F9-s1-c1-zzzz"]
    assert sorted(spark.table(index.terms).filter("task = 'T003'").inputFiles()) == other
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_lists_of_chunks(spark, index):
    """A term's chunks are lists of a run of numbers, not rows; each chunk is met by its number, equal ids too."""
    rows = spark.range(3000, numPartitions=2).select(F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("task"), F.concat(F.lit("c"), F.col("id") % 2500).alias("chunk_id"), F.lit("d").alias("document_id"), F.when(F.col("id") % 2 == 0, "abcd").otherwise("xyz").alias("content"), F.lit("").alias("section"), F.lit(1).alias("page"), F.lit(0.5).alias("confidence"), F.lit(False).alias("requires_human_review"))
    index.write(rows)
    lists = index.postings("A", ["ab", "abcd", "xy"])
    assert lists.count() == 6  # of two tasks that wrote
    of = {r["term"]: r["n"] for r in lists.groupBy("term").agg(F.sum(F.size("places")).alias("n")).collect()}
    assert of == {"ab": 500, "abcd": 500, "xy": 500}
    assert {r["score"] for r in index.search("B", "abcd", 50).collect()} == {r["score"] for r in R.search(rows.filter("task = 'B'"), "abcd", 50).collect()}


def test_runs_and_tasks_in_one_batch():
    numbers = [5, 5 + R.RUN, 6, (1 << 33) + 1, 7]
    batch = pa.RecordBatch.from_pydict({"n": pa.array(numbers), "task": pa.array(["a", "a", "b", None, "a"]), "terms": pa.array([["x", "y"], ["x"], ["x"], ["y"], None])})
    got = {(r["term"], r["task"], r["run"] * R.RUN + p) for b in R._posted(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist() for p in r["places"]}
    assert got == {("x", "a", 5), ("y", "a", 5), ("x", "a", 5 + R.RUN), ("x", "b", 6), ("y", None, (1 << 33) + 1)}
    assert list(R._posted(iter([batch.slice(4)]))) == [] == list(R._posted(iter([])))


def test_a_task_without_terms_replaces_its_lists(spark, index):
    index.write(spark.createDataFrame(CHUNKS, SCHEMA))
    index.write(spark.createDataFrame([("T001", "N1", "F1", " ", "s", 1, 0.5, False), ("T001", "N2", "F1", None, "s", 1, 0.5, False)], SCHEMA))
    assert index.postings("T001", ["限价"]).count() == 0 == index.search("T001", "最高投标限价").count()
    assert ids(index.search("T003", "最高投标限价")) == ["F9-s1-c1-zzzz"]


def plain(chunks, query, limit):
    def of(text):
        low = re.sub(r"\s+", "", text.lower())
        return {low[i : i + 2] for i in range(len(low) - 1)} | set(re.findall(r"[a-z0-9_.-]{2,}", text.lower()))

    wanted, have, out = of(query), {c[1]: of(c[3]) for c in chunks}, []
    idf = {t: math.log((len(chunks) + 1) / (sum(t in h for h in have.values()) + 0.5)) + 1 for t in wanted}
    whole = re.sub(r"\s+", "", query.lower())
    for c in chunks:
        met = wanted & have[c[1]]
        if met and (len(wanted) < 3 or len(met) / len(wanted) >= 0.3):
            s = sum(idf[t] for t in met) / max(1.0, sum(idf.values())) + 0.25 * (whole in re.sub(r"\s+", "", c[3].lower())) + 0.12 * (whole in re.sub(r"\s+", "", c[4].lower()))
            out.append((round(min(1.0, max(0.0, s + 0.05 * c[6] - 0.02 * c[7])), 4), c[1]))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:limit]


def test_scan_and_index_against_a_plain_score(spark, index):
    draw = random.Random(12)
    words = ["licence", "a", "it", "the", "x.y", "foo_bar", "最高", "限价", "Of", "2026-01", "end."]
    chunks = [("A", f"c{i:03}", "d", draw.choice([" ", "", "\n"]).join(draw.choice(words) for _ in range(draw.randrange(1, 15))), draw.choice(["", "the end", "licence"]), 1, draw.choice([0.5, 0.9]), draw.random() < 0.3) for i in range(120)]
    df = spark.createDataFrame(chunks, SCHEMA).repartition(3)
    index.write(df)
    for query in ("licence of the end.", "最高限价 2026-01", "it", "the", "foo_bar x.y a"):
        want = plain(chunks, query, 50)
        assert [(r["score"], r["chunk_id"]) for r in R.search(df, query, 50).collect()] == want
        assert [(r["score"], r["chunk_id"]) for r in index.search("A", query, 50).collect()] == want
