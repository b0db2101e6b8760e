"""The cache as a stream: put, hit, expiry, no end, versions apart, and going on from a checkpoint."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sievemark.exprs import canonical_json
from sievemark.streaming import cache as C

SCHEMA = "key string, seq long, at timestamp, op string, payload string"
T0 = dt.datetime(2024, 3, 1, 12)


def requests(*rows):
    return [(k, i, T0 + dt.timedelta(seconds=s), op, p) for i, (k, s, op, p) in enumerate(rows)]


def answers(df):
    return {r["seq"]: r["payload"] if r["hit"] else None for r in df.collect()}


ROWS = requests(("a", 0, "get", None), ("a", 1, "put", "1"), ("a", 60, "get", None), ("b", 60, "get", None), ("a", 61, "get", None), ("a", 62, "get", None), ("a", 62, "put", "2"), ("a", 63, "put", "3"), ("a", 63, "get", None), ("a", 64, "put", None), ("a", 65, "get", None), (None, 5, "put", "n"), (None, 6, "get", None))


@pytest.mark.parametrize("stream", [False, True])
@pytest.mark.parametrize("ttl", [60, 0, -1])
def test_put_get_and_expiry(spark, tmp_path, ttl, stream):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    if stream:
        rows.write.parquet(str(tmp_path / "in"))
        C.run_available(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), ttl)
    got = answers(spark.read.parquet(str(tmp_path / "out")) if stream else C.cached(rows, ttl))
    # an entry of 60 seconds is alive after 60, gone after 61; one of none within its second
    want = {0: None, 2: "1", 3: None, 4: "1", 5: None, 8: "3", 10: None, 12: "n"} if ttl == 60 else {0: None, 2: None, 3: None, 4: None, 5: None, 8: "3", 10: None, 12: None} if ttl == 0 else {0: None, 2: "1", 3: None, 4: "1", 5: "1", 8: "3", 10: None, 12: "n"}
    assert got == want


def test_restart_from_a_checkpoint(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    frame(requests(("a", 0, "put", "1"), ("b", 0, "get", None))).coalesce(1).write.parquet(src)
    C.run_available(stream(), out, state, 100)
    later = [("a", 10, T0 + dt.timedelta(seconds=s), "get", None) for s in (50,)] + [("a", 11, T0 + dt.timedelta(seconds=200), "get", None), ("b", 12, T0, "put", "x")]
    frame(later).coalesce(1).write.mode("append").parquet(src)
    C.run_available(stream(), out, state, 100)
    frame([("b", 20, T0, "get", None), ("a", 21, T0, "get", None)]).coalesce(1).write.mode("append").parquet(src)
    C.run_available(stream(), out, state, 100)
    got = answers(spark.read.parquet(out))
    assert got == {1: None, 10: "1", 11: None, 20: "x", 21: None}  # the expired entry of a was deleted
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != C.ROCKS["spark.sql.streaming.stateStore.providerClass"]


def test_keys(spark):
    inputs = [{"b": 1, "a": [1, {"d": None, "c": "é\"\\\n"}]}, "text", 3, None, []]
    rows = [("ns", json.dumps(x, ensure_ascii=False, indent=2), "w1", "r1") for x in inputs]
    rows += [("ns", '{"a":[1,{"c":"é\\"\\\\\\n","d":null}], "b":1}', "w1", "r1"), ("ns", json.dumps(inputs[0]), "w2", "r1"), ("ns", json.dumps(inputs[0]), "w1", "r2"), ("other", json.dumps(inputs[0]), "w1", "r1"), ("ns", "no json {", "w1", "r1")]
    df = spark.createDataFrame(rows, "n string, i string, w string, r string").coalesce(1)
    got = [r["k"] for r in df.select(C.cache_key("n", "i", "w", "r").alias("k")).collect()]
    plain = [hashlib.sha256(json.dumps({"namespace": n, "input": json.loads(i), "workflow_version": w, "ruleset_version": r}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for n, i, w, r in rows[:-1]]
    assert got[:-1] == plain and got[0] == got[5] and len(set(got)) == len(got) - 1


def test_canonical_json(spark):
    text = ['{"z": 1, "a": {"y": [true, null, 1.5], "x": "s"}}', " [ ] ", "nonsense", None, '{"a":1,"a":2}', "1e400"]
    got = [r["j"] for r in spark.createDataFrame([(t,) for t in text], "t string").coalesce(1).select(canonical_json(F.col("t")).alias("j")).collect()]
    assert got[:4] == ['{"a":{"x":"s","y":[true,null,1.5]},"z":1}', "[]", None, None]
