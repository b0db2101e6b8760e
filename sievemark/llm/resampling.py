"""Importance resampling towards a target distribution over hashed word n-grams.

A feature is a run of 1 to ``order`` words; its bucket is the CRC-32 of its bytes. Each word's CRC is computed once; the
CRC of a run is composed from its words' by ``words.CrcAlgebra``, so no n-gram string is ever made.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import Scratch
from .decontamination import SEPARATORS
from .words import CrcAlgebra, pieces, word_batches

ORDER, BUCKETS = 2, 10_000
SEED, MIN_WORDS, PERCENT = 7, 20, 25
_SEPARATOR = re.compile(b"[" + re.escape(SEPARATORS) + b"]")
_WORD = re.compile(b"[^" + re.escape(SEPARATORS) + b"]+")
_ALGEBRA: list[CrcAlgebra] = []


def _algebra() -> CrcAlgebra:
    if not _ALGEBRA:
        _ALGEBRA.append(CrcAlgebra())
    return _ALGEBRA[0]


def word_crcs(data: bytes) -> np.ndarray:
    """(crc, length) of each word of lower-cased UTF-8, as an array of two columns."""
    out = []
    for piece in pieces(data, _SEPARATOR):
        found = _WORD.findall(piece)
        out.append(np.stack([np.fromiter(map(zlib.crc32, found), np.int64, len(found)), np.fromiter(map(len, found), np.int64, len(found))], axis=1))
    return np.concatenate(out)


def run_crcs(crc: np.ndarray, length: np.ndarray, doc: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length: CRCs of the runs that begin at each word (uint32), and whether the run stays in its text."""
    algebra, crc = _algebra(), crc.astype(np.uint32)
    run, inside = crc, np.ones(len(crc), bool)
    yield run, inside
    for n in range(1, order):
        at = len(crc) - n
        if at <= 0:
            return
        run = algebra.append(algebra.append_byte(run[:at], b" "), crc[n:], length[n:])
        inside = doc[:at] == doc[n:]
        yield run, inside


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    both = np.concatenate(parts)
    return both[:, 0], both[:, 1], np.repeat(np.arange(len(parts)), sizes), sizes


def bucket_counts(df: DataFrame, *, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all whole texts fall in each bucket (int64). One array for each task shuffles, summed in two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, parts in word_batches(batch.column(0), word_crcs):
                crc, length, doc, _ = _flat(parts)
                for code, inside in run_crcs(crc, length, doc, order):
                    total += np.bincount(code[inside] % np.uint32(buckets), minlength=buckets)
        yield pa.RecordBatch.from_pylist([{"part": 0, "counts": zlib.compress(total.tobytes(), 1)}], schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    parts = common.map_arrow(df.select(F.col(text_col).alias("text")), run, "part int, counts binary").withColumn("task", F.spark_partition_id())
    rows = common.sum_arrays(parts, {"part": "int"}).collect()  # one row, of a size that the buckets fix
    return np.frombuffer(zlib.decompress(rows[0]["counts"]), "<i8") if rows else np.zeros(buckets, np.int64)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of target over source, both smoothed by one, rounded down (int64)."""
    buckets, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((float(b) + 1) * (s + buckets)) / ((float(a) + 1) * (t + buckets)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(df: DataFrame, gains: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row: the mean gain of its features, rounded down; 0 without words."""
    buckets = np.uint32(len(gains))

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for first, end, parts in word_batches(batch.column(1), word_crcs):
                crc, length, doc, sizes = _flat(parts)
                total, features = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
                for code, inside in run_crcs(crc, length, doc, order):
                    upto = np.minimum(np.concatenate([[0], np.cumsum(sizes)]), len(code))
                    total += np.diff(np.concatenate([[0], np.cumsum(np.where(inside, gains[code % buckets], 0))])[upto])
                    features += np.diff(np.concatenate([[0], np.cumsum(inside)])[upto])
                mean = np.where(features > 0, total // np.maximum(features, 1), 0)
                cols = [batch.column(0).slice(first, end - first), pa.array(sizes), pa.array(features), pa.array(mean)]
                out.append(pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_features", "weight"]))
            return common.joined(out)

        return step

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_batches(rows, start, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousandfold Gumbel number drawn by the SHA-256 of seed and id, rounded down: top scores are then a draw by weight."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


#: Rows of equal values that one row stands for while ranks are expanded.
COPIES = 100_000


def resample(df: DataFrame, target: DataFrame, *, scratch: Scratch, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``df``; rank is null where a row isn't drawn.

    * Null and empty texts have no words, weight 0 and rank null; a null id is drawn by the text of the seed alone, and
      counts as the smallest id;
    * repeated rows and equal ids are rows of their own; ties of score go to the smaller id, then to fewer features,
      and rows alike in all of that take following ranks;
    * an empty ``df`` gives no rows; with an empty ``target`` every bucket's target count is 0; other columns aren't read.

    Whole texts are read twice, once for the counts, once for the weights. Only rows of five numbers shuffle: equal ones
    are counted before the shuffle, ranges of the score are numbered by themselves, and one total for each range goes
    through the driver.
    """
    counts = [bucket_counts(x, text_col=text_col) for x in (df, target)]
    scored = weights(df, bucket_gains(*counts), id_col=id_col, text_col=text_col).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    own = ["doc_id", "n_features", "weight", "score"]
    groups = scored.groupBy(*own, (F.col("n_words") >= min_words).alias("may")).agg(F.count("*").alias("n"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc(), F.col("weight").asc()]
    # one written table fixes the ranges, whatever is computed again later
    ranged = scratch.keep(groups.repartitionByRange(F.col("may").desc(), *order).withColumn("pid", F.spark_partition_id()), "scores")
    before, drawn = [], 0
    for pid, n in sorted(map(tuple, ranged.filter("may").groupBy("pid").agg(F.sum("n")).collect())):
        before.append((pid, drawn))
        drawn += n
    drawn = percent * drawn // 100
    offsets = df.sparkSession.createDataFrame(before, "pid int, before long")  # a row for each partition
    within = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n").over(within), F.lit(0))
    ranked = ranged.filter("may").withColumn("inside", inside).join(F.broadcast(offsets), "pid").select(*own, "n", F.expr("before + inside + 1").alias("first"))
    rest = ranged.filter("not may").select(*own, "n", F.lit(None).cast("long").alias("first"))
    # copies of a row: whole blocks of them first, dealt out, then the rows of a block
    many = ranked.unionByName(rest)
    blocks = many.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    blocks = blocks.withColumn("here", F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("block") * COPIES))
    one = blocks.filter("n = 1").withColumn("at", F.lit(0).cast("long"))
    more = blocks.filter("n > 1").repartition("doc_id", "score", "block").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("here") - 1)))
    rank = F.col("first") + F.col("block") * COPIES + F.col("at")
    return one.unionByName(more).select(*own, F.when(rank <= drawn, rank).alias("rank"))


#: What ``resample`` gives over ``documents`` and ``benchmark``. DuckDB has no CRC; its table of bytes is built here from
#: the polynomial, and a string's CRC is folded over its bytes.
ORACLE_SQL = r"""
WITH crctable AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)),
texts AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (
  SELECT side, row, unnest(w) AS f FROM texts
  UNION ALL
  SELECT side, row, w[i] || ' ' || w[i + 1] FROM (SELECT side, row, w, unnest(generate_series(1, len(w) - 1)) AS i FROM texts)),
counted AS (SELECT side, row, f, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT f, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)) AS b FROM (SELECT DISTINCT f FROM counted)),
bucket AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) AS INT) + 1])), 4294967295) % 10000 AS k
  FROM bytes, crctable),
held AS (SELECT side, row, k, sum(n) AS n FROM counted JOIN bucket USING (f) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM held),
per AS (SELECT k, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM held GROUP BY k),
gains AS (
  SELECT k, floor(1000 * ln(((per.t + 1)::DOUBLE * (totals.s + 10000)::DOUBLE) / ((per.s + 1)::DOUBLE * (totals.t + 10000)::DOUBLE))) AS g
  FROM per, totals),
means AS (SELECT row, sum(n) AS n, floor(sum(n * g) / sum(n)) AS weight FROM held JOIN gains USING (k) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT id AS doc_id, CAST(coalesce(means.n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(w) AS words,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN means USING (row) WHERE side = 'd'),
ranked AS (SELECT *, words >= 20 AS may, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS r, count(*) FILTER (words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""
