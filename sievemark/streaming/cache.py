"""A versioned cache of results as a stream operator: entries are state in RocksDB that expires.

A request puts or gets the entry of a key; the key is the SHA-256 of namespace, input and versions as canonical JSON, so
another version of a workflow or of its rules never sees an entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..exprs import canonical_json, col

#: Seconds that an entry lives.
TTL_SECONDS = 604_800
#: State that expires needs RocksDB. Without the second setting a run over what is there would never end: as its time goes
#: by the clock, the operator always asks for one more batch, without data.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
REQUEST = ("seq", "us", "op", "payload")


def cache_key(namespace: str | Column, given: str | Column, workflow_version: str | Column, ruleset_version: str | Column) -> Column:
    """given: the input as JSON text. Objects that differ in the order of their keys or in white space alone are one input.

    Input that is no JSON counts as a string.
    """
    text = col(given)
    value = F.coalesce(canonical_json(text), F.to_json(F.struct(text.alias("s"))))
    plain = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(col(c), F.lit("")).alias("s"))), r"(?s)^\{\"s\":(.*)\}$", 1)
    return F.sha2(F.concat(F.lit('{"input":'), value, F.lit(',"namespace":'), plain(namespace), F.lit(',"ruleset_version":'), plain(ruleset_version), F.lit(',"workflow_version":'), plain(workflow_version), F.lit("}")), 256)


class _Entries(StatefulProcessor):
    """One key's entry. Requests of a batch are taken by time and then ``seq``; other keys' requests never wait for it."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        # The store forgets an entry so long after it was written, by the clock; a stream that stood still for longer
        # than that finds fewer entries than its requests' times allow.
        self.entry = handle.getValueState("entry", "payload string, us long", None if self.ttl < 0 else (self.ttl + 1) * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked = pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")
        held = self.entry.get() if self.entry.exists() else None
        now, changed, out = tuple(held) if held is not None else None, False, []
        for seq, us, op, payload in asked[list(REQUEST)].itertuples(index=False):
            if op == "put":
                now, changed = (payload, us), True
                continue
            if now is not None and 0 <= self.ttl < (us - now[1]) // 1_000_000:
                now, changed = None, True
            out.append((key[0], seq, us, now is not None, now[0] if now is not None else None))
        if changed and now is None:
            self.entry.clear()
        elif changed:
            self.entry.update((now[0], int(now[1])))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "us", "hit", "payload"])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """(key, seq, at, hit, payload) for each get. requests: key, seq, at, op (put or get), payload.

    A get sees the last put before it, if that is at most ``ttl_seconds`` whole seconds old; a negative time to live never
    ends. A put replaces the entry and starts its time anew. Null keys are one key. A stream keeps entries as state, with
    the settings of ROCKS; a batch finds each get's put in a window over the key's requests.
    """
    asked = requests.withColumn("us", F.unix_micros(F.col("at").cast("timestamp"))).select("key", *REQUEST)
    if requests.isStreaming:
        answers = asked.groupBy("key").transformWithStateInPandas(statefulProcessor=_Entries(ttl_seconds), outputStructType="key string, seq long, us long, hit boolean, payload string", outputMode="Append", timeMode="ProcessingTime")
    else:
        before = Window.partitionBy("key").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.last(F.when(F.col("op") == "put", F.struct("payload", "us")), ignorenulls=True).over(before)
        age = F.floor((F.col("us") - F.col("last.us")) / 1_000_000)
        hit = F.col("last").isNotNull() & (F.lit(ttl_seconds < 0) | (age <= ttl_seconds))
        answers = asked.withColumn("last", last).filter("op <> 'put'").withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("payload", F.when(F.col("hit"), F.col("last.payload")))
    return answers.select("key", "seq", F.timestamp_micros("us").alias("at"), "hit", "payload")


def run_available(requests: DataFrame, out: str, checkpoint: str, ttl_seconds: int = TTL_SECONDS) -> None:
    """Answers all requests that are there into parquet files, and ends; the next run goes on from the checkpoint."""
    spark = requests.sparkSession
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        cached(requests, ttl_seconds).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
