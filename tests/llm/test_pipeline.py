"""The pipeline's stages against plain Python on a small table."""

import hashlib
import re
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F

from sievemark.llm import decontamination as D

SF = "/root/testdata/sf0.001"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_representatives(texts):
    """The smallest id of each component of five-word Jaccard 0.8, by comparing all pairs."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(A_TO_Z)) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return {root(i) for i in sets}


def test_stages(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    # near copies, and texts without a letter: the smallest tables have few
    first = given.orderBy(F.desc("n_chars")).select("text").first()["text"]
    own = [(10**6, f"{first} one more word"), (10**6 + 1, f"one {first} more word"), (10**6 + 2, "123 ... 456"), (10**6 + 3, ""), (10**6 + 4, None)]
    more = spark.createDataFrame([(i, t, None, "x", len(t or "")) for i, t in own], given.schema)
    given.unionByName(more).write.parquet(str(tmp_path / "given"))
    docs = spark.read.parquet(str(tmp_path / "given"))
    items = [D.words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)}
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows, kept = before.collect(), {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "packing":
            assert kept == {r["doc_id"] for r in rows}
            assert out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).filter("n <> t").count() == 0
            continue
        assert out.columns == columns
        if name == "language_id":
            assert {r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or "")} - kept == set()
            assert not kept & {r["doc_id"] for r in rows if not any(c.isalpha() for c in r["text"] or "")}
            assert len(kept) < len(rows)
        if name == "jaccard_join":
            assert kept == brute_representatives({r["doc_id"]: r["text"] or "" for r in rows})
        if name == "exact_dedup":
            best = {}
            for r in rows:
                sha = hashlib.sha256((r["text"] or "").encode()).digest()
                best[sha] = max(best.get(sha, -1), r["doc_id"])
            assert kept == set(best.values())
        if name == "decontamination":
            clean = {r["doc_id"] for r in rows if not any(tuple(w[i : i + n]) in windows for w in [D.words(r["text"])] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))}
            assert kept == clean
        before = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "packing"]
