"""Contiguous shards of nearly equal bytes, cut by global prefix sums from per-partition totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes counted for a row besides its text.
ROW_BYTES = 8


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, g1, g2): g1 and g2 are a 128-bit hash that stands for the group of equal texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(7), text).alias("g2"),
    )


TOTALS = pa.schema([(c, pa.int64()) for c in ("pid", "rows", "bytes", "head", "tail", "f1", "f2", "l1", "l2")])


class _Partition:
    """A sorted partition's numbers as arrays, and its runs of equal groups."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.table = pa.Table.from_batches(list(batches))
        if self.table.num_rows:
            g1, g2, self.size = (self.table[c].to_numpy() for c in ("g1", "g2", "size"))
            new = np.ones(len(g1), bool)
            new[1:] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])
            self.starts, self.run = np.flatnonzero(new), np.cumsum(new) - 1
            self.bytes = np.add.reduceat(self.size, self.starts)
            self.ends = tuple(int(x) for x in (g1[0], g2[0], g1[-1], g2[-1]))
            self.pid = self.table["pid"][0].as_py()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole for whole in [list(batches)] if whole):
        p = _Partition(batch)
        if p.table.num_rows:
            row = [p.pid, p.table.num_rows, int(p.bytes.sum()), int(p.bytes[0]), int(p.bytes[-1]), *p.ends]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], schema=TOTALS)


def _layout(totals: list) -> tuple[dict[int, tuple[int, int, int, int]], int]:
    """Per partition: rows before it, the global start and bytes of its first group, bytes of its last; and all bytes.

    Groups that run over partitions are joined here: one small row for each partition is all the driver sees.
    """
    spans: list[list[int]] = []  # start and bytes of each first or last group
    where, rows, at, last = {}, 0, 0, None
    for t in sorted(totals, key=lambda t: t["pid"]):
        if (t["f1"], t["f2"]) == last:
            spans[-1][1] += t["head"]
        else:
            spans.append([at, t["head"]])
        head = len(spans) - 1
        last = (t["l1"], t["l2"])
        if (t["f1"], t["f2"]) != last:
            spans.append([at + t["bytes"] - t["tail"], t["tail"]])
        where[t["pid"]] = (rows, at, head, len(spans) - 1)
        rows, at = rows + t["rows"], at + t["bytes"]
    return {pid: (r, a, spans[h][0], spans[h][1], spans[z][1]) for pid, (r, a, h, z) in where.items()}, at


def shard_by_bytes(df: DataFrame, shards: int, *, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): contiguous runs of the order (text hash, id) with nearly equal bytes.

    Rows with equal texts share a shard: a group goes where its middle byte falls, so a shard is off its target by
    less than the largest group at either end, and a group larger than a shard makes that shard larger. slot counts a
    shard's rows from 0 without gaps; equal (text, id) rows take neighbouring slots. Null text has no bytes (a row
    still counts ROW_BYTES) and shares a group with empty text; null ids come first. Other columns aren't read. An
    empty table gives no rows; shards that get no row do not appear.

    Only (id, size, hash) rows are sorted, by range, so that a hot group spreads over partitions.
    """
    rows = sized(df, id_col, text_col).orderBy("g1", "g2", "doc_id", "size").withColumn("pid", F.spark_partition_id())
    rows = scratch.checkpoint(rows)  # and not a table, whose files would be dealt to tasks anew
    where, total = _layout(rows.mapInArrow(_totals, "pid long, rows long, bytes long, head long, tail long, f1 long, f2 long, l1 long, l2 long").collect())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        p = _Partition(batches) if batches else None
        if p is None or not p.table.num_rows:
            return
        before, at, head_start, head_bytes, tail_bytes = where[p.pid]
        start = at + np.concatenate([[0], np.cumsum(p.bytes)[:-1]])
        size = p.bytes.copy()
        start[0], size[-1], size[0] = head_start, tail_bytes, head_bytes
        # exact at any size: twice the middle byte times the shards can pass 63 bits
        shard = np.array([(2 * int(s) + int(b)) * shards // (2 * total) for s, b in zip(start, size, strict=True)], np.int32)
        table = p.table.select(["doc_id", "size", "text_crc32"])
        table = table.append_column("shard", pa.array(shard[p.run])).append_column("row", pa.array(before + np.arange(table.num_rows), pa.int64()))
        yield from table.to_batches()

    placed = rows.mapInArrow(assign, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, shard int, row long")
    first = scratch.keep(placed.groupBy("shard").agg(F.min("row").alias("first")), "first")  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the rows of ``df`` as a folder for each shard, in slot order within a file."""
    joined = df.join(assigned.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
