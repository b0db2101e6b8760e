"""Shared pieces of the training-data operators: scratch storage, batches, hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit odd multiplier and finaliser constants (fixed values: splitmix64).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without it."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if given:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(given)
        return given.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievemark-"))
    return sc.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have gone by the time the interpreter ends
        pass


#: Roots whose kept tables go when the interpreter ends.
_KEPT: set[str] = set()


def kept_roots() -> set[str]:
    return set(_KEPT)


def forget(spark: SparkSession, roots: set[str]) -> None:
    """Deletes the kept tables under ``roots``, which nothing may read any more."""
    for root in roots:
        _KEPT.discard(root)
        _delete(spark, root)


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``save`` tables go when the block ends; ``keep`` tables, which a returned DataFrame still reads, when the
    interpreter does.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sievemark-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        _delete(self.spark, f"{self.root}/tmp")

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self._write(df, f"{self.root}/tmp/{name}-{uuid.uuid4().hex[:8]}")

    def drop(self, *dfs: DataFrame) -> None:
        """Deletes saved tables that nothing reads any more."""
        for df in dfs:
            for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
                _delete(self.spark, f)

    def _held(self, path: str) -> None:
        if path not in _KEPT:
            _KEPT.add(path)
            atexit.register(_delete, self.spark, path)

    def checkpoint(self, df: DataFrame) -> DataFrame:
        """A reliable checkpoint, which keeps partitions and their order; it goes when kept tables do."""
        out = df.checkpoint()
        path = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if path.isDefined():
            self._held(path.get())
        return out

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._held(self.root)
        return self._write(df, f"{self.root}/keep/{name}-{uuid.uuid4().hex[:8]}")


#: Most rows of an Arrow batch that carries texts.
BATCH_ROWS = 1000


def release() -> None:
    """Gives a Python worker's free memory back to the system: workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has its own ways
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """mapInArrow that releases what a task held when it ends.

    Texts are long, so the session's Arrow batches are set to BATCH_ROWS rows where they may be larger.
    """
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(size)) <= BATCH_ROWS:
        df.sparkSession.conf.set(size, str(BATCH_ROWS))

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(released, schema)


def map_batches(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with per-task state: ``fn()`` is called once in a task and gives the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out

    return map_arrow(df, run, schema)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``rows`` rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    """The batches as one; None without rows."""
    parts = [p for p in parts if p.num_rows]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def sum_arrays(parts: DataFrame, keys: dict[str, str], spread: int = 64) -> DataFrame:
    """(keys, counts): sums of arrays that tasks sent as rows (keys, task, counts), zlib over little-endian int64.

    Summed in two levels, first among the tasks of one of ``spread`` residues, then all. A task adds up rows as they
    come and holds one array for each key it was dealt, however many tasks sent one.
    """
    names = list(keys)
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", task int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple] = {}
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                own = np.frombuffer(zlib.decompress(row[-1]), "<i8")
                task, held = sums.get(row[:-2], (row[-2], None))
                if held is None:
                    held = own.copy()
                else:
                    held += own
                sums[row[:-2]] = (min(task, row[-2]), held)
        for key, (task, held) in sums.items():
            yield pa.RecordBatch.from_pylist([dict(zip(names, key, strict=True)) | {"task": task, "counts": zlib.compress(held.tobytes(), 1)}], schema=to_arrow)

    to_arrow = pa.schema([(k, {"int": pa.int32(), "string": pa.string()}[t]) for k, t in keys.items()] + [("task", pa.int32()), ("counts", pa.binary())])
    rows = parts.select(*names, "task", "counts")
    level = map_arrow(rows.repartition(*names, F.pmod("task", F.lit(spread))), run, schema)
    return map_arrow(level.repartition(*names), run, schema).select(*names, "counts")


def set_bits(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits positions, set where ``column`` modulo that number occurs: its size is fixed, whatever the rows.

    Built from partial bitmaps of 2**15 positions; at most 2**(bits - 15) rows of 4 KB reach the driver.
    """
    at = F.pmod(F.col(column), F.lit(1 << bits)) + 1  # the bitmap functions count positions from 1
    parts = (
        rows.select(at.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
        .collect()
    )
    out = np.zeros(max(1 << bits, 1 << 15) // 8, dtype=np.uint8)
    for bucket, bitmap in parts:
        raw = np.frombuffer(bytes(bitmap), dtype=np.uint8)
        start = (bucket - 1) * 4096
        out[start : start + len(raw)] |= raw
    return out


def has_bits(bitmap: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Whether each int64 value may have been given to ``set_bits``."""
    at = np.mod(values.astype(np.int64), np.int64(1 << bits))
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


#: Most rows of a small relation (a few numbers a row) that is broadcast to a join; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (src long, dst long); component is the smallest node reachable.

    Min-label propagation with pointer jumping. Only rows of edges and labels move; minima are aggregated before the
    shuffle, so a hub with very many neighbours costs one row for each task. Each round is a written table.
    """
    both = scratch.save(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct(), "edges")
    rows = both.count()
    labels = scratch.save(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(small(labels.select(F.col("node").alias("dst"), F.col("label").alias("l")), rows), "dst").groupBy(F.col("src").alias("node")).agg(F.min("l").alias("l"))
        step = labels.join(small(near, rows), "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(small(up, rows), "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = scratch.save(step, "labels")
        changed = step.filter("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
