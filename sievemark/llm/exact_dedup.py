"""Exact deduplication: a counting Bloom filter finds the hashes that may repeat, and only those rows shuffle.

The filter comes in parts by a hash of the row, as many as the rows need; each row asks its own part alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Positions of one part of the filter, as a power of two: the largest part is 512 MB. Parts are broadcast one by one.
MIN_BITS, MAX_BITS = 18, 32
#: Most parts. They take 4 GB of an executor together, which only tables of over 10**9 rows ask for.
MAX_PARTS = 8
#: Positions of the filter for each row, while the parts allow; and positions that a row sets, one where they are few.
POSITIONS_PER_ROW, HASHES = 16, 2


def filter_size(rows: int) -> tuple[int, int, int]:
    """(parts, bits of a part, positions a row sets) for so many rows.

    With 16 positions a row 2 in 100 rows without a copy shuffle; at 10**10 rows, with 3.4 positions each, 1 in 4.
    """
    need = max(1, rows * POSITIONS_PER_ROW)
    bits = min(MAX_BITS, max(MIN_BITS, (need - 1).bit_length()))
    parts = min(MAX_PARTS, -(-need >> bits))
    return parts, bits, HASHES if parts << bits >= 8 * rows else 1


def _part(sha: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(-1)), F.lit(parts)).cast("int")


def _positions(sha: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(1 << bits)) for i in range(hashes)]


def repeated_filter(rows: DataFrame, sha: str, parts: int, bits: int, hashes: int) -> DataFrame:
    """First pass: the positions that two or more rows set, as (part, bucket, bitmap) with 2**15 positions a bitmap.

    A row for each task and position at most is shuffled, so a hash that a third of all rows share is no hot key.
    """
    at = F.explode(F.array(*_positions(F.col(sha), bits, hashes)))
    twice = rows.select(_part(F.col(sha), parts).alias("part"), at.alias("at")).groupBy("part", "at").count().filter("count > 1").withColumn("at", F.col("at") + 1)
    return twice.groupBy("part", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def may_repeat(df: DataFrame, twice: DataFrame, sha: str, parts: int, bits: int, hashes: int) -> DataFrame:
    """Second pass: adds ``__maybe``. A broadcast part has at most 2**bits / 8 bytes, whatever the input."""
    hits = []
    for k in range(parts):
        own = F.broadcast(twice.filter(F.col("part") == k))
        hit = F.lit(True)
        for i, at in enumerate(_positions(F.col(sha), bits, hashes)):
            words = own.select(F.col("bucket").alias(f"__w{k}_{i}"), F.col("bitmap").alias(f"__m{k}_{i}"))
            place = F.when(_part(F.col(sha), parts) == k, at) if parts > 1 else at
            df = df.withColumn(f"__p{k}_{i}", place).join(words, F.expr(f"(__p{k}_{i} div 32768) + 1") == F.col(f"__w{k}_{i}"), "left")
            byte = F.expr(f"cast(conv(hex(substring(__m{k}_{i}, cast((__p{k}_{i} % 32768) div 8 as int) + 1, 1)), 16, 10) as int)")
            hit = hit & (F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(__p{k}_{i} % 8 as int))")), F.lit(0)) != 0)
        hits.append(hit)
    any_hit = hits[0]
    for hit in hits[1:]:
        any_hit = any_hit | hit
    return df.withColumn("__maybe", any_hit).drop(*[f"__{c}{k}_{i}" for k in range(parts) for i in range(hashes) for c in "pwm"])


def _groups(df: DataFrame, id_col: str, text_col: str, scratch: Scratch, size: tuple[int, int, int] | None) -> DataFrame:
    """(row struct of all columns, keep_id, group_size, kept, text_sha256): the row stays a struct, so no name clashes."""
    base = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    # The scan's order, the same for a task run again; the hash keeps all columns in both passes, so that the scan is one.
    plain = [f"row.`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString()]
    base = base.withColumn("at", F.struct(F.xxhash64(*plain).alias("mark"), F.monotonically_increasing_id().alias("place")))
    size = size or filter_size(df.count())
    twice = scratch.keep(repeated_filter(base, "text_sha256", *size), "twice")
    tested = may_repeat(base, twice, "text_sha256", *size)
    single = tested.filter("not __maybe").select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = tested.filter("__maybe")
    same = maybe.groupBy(F.col("text_sha256").alias("sha"), F.col("id").alias("own")).agg(F.count("*").alias("n"), F.max("at").alias("last"))
    groups = same.groupBy("sha").agg(F.sum("n").alias("group_size"), F.max(F.struct(F.col("own").alias("id"), "n", "last")).alias("best"))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & ((F.col("best.n") == 1) | (F.col("best.last") == F.col("at")))
    # A hot text is split by the skew-join rule; the group's side has one row for each text.
    joined = maybe.join(groups, F.col("text_sha256") == F.col("sha"))
    return single.unionByName(joined.select("row", F.col("best.id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scratch: Scratch, bits: int | None = None, parts: int = 1) -> DataFrame:
    """Every row of ``df`` with keep_id, group_size, kept and text_sha256 of its group of equal texts.

    * null text counts as empty; texts are equal when identical, without any normalisation;
    * the row with the largest ``id_col`` stays (null ids are smallest); of rows that also share the id, exactly one,
      told by its place in the scan: ``df`` must then be read from a table;
    * columns of ``df`` named like an output column are replaced; others, whatever their names, are carried along;
    * an empty table gives an empty result.

    Rows whose hash cannot repeat pass straight through. The others shuffle once for the group's figures, aggregated
    before the shuffle, and once to meet them. How many rows the filter lets through to the shuffle sets speed, never
    results; ``filter_size`` states it. ``bits`` and ``parts`` override the filter's size.
    """
    names = ["keep_id", "group_size", "kept", "text_sha256"]
    own = [F.col("row").getField(c).alias(c) for c in df.columns if c not in names]
    size = None if bits is None else (parts, bits, HASHES)
    return _groups(df, id_col, text_col, scratch, size).select(*own, *names)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scratch: Scratch) -> DataFrame:
    """The rows of ``df`` that stay, with all its columns and no others."""
    return _groups(df, id_col, text_col, scratch, None).filter("kept").select("row.*")
