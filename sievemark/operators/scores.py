"""Checks over score, price and rank records. Each takes and gives DataFrames; keys may hold a task's id as well.

Groups are aggregated with partial sums before any shuffle; windows are keyed by the record's group only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..exprs import col, is_close, weight_ratio
from ..storage import written


def mean_then_sum(df: DataFrame, keys: list[str], factor: str, value: str | Column, out: str = "calculated") -> DataFrame:
    """The mean of each factor, summed over a group's factors. Rows without value don't count; a blank factor is one of its own."""
    rows = df.withColumn("__v", col(value)).filter("__v IS NOT NULL")
    return rows.groupBy(*keys, factor).agg(F.avg("__v").alias("__m")).groupBy(*keys).agg(F.sum("__m").alias(out))


def last_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key in the given order: one max of a struct, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def weighted_mismatches(details: DataFrame, raw: str, weight: str, weighted: str, tolerance: float = 0.02) -> DataFrame:
    """Rows whose weighted score is not raw times weight, with ``expected``."""
    return details.withColumn("expected", F.col(raw) * weight_ratio(weight)).filter(F.col(weighted).isNotNull() & F.col("expected").isNotNull()).filter(~is_close(F.col("expected"), F.col(weighted), tolerance))


def total_mismatches(details: DataFrame, summaries: DataFrame, keys: list[str], factor: str, value: str | Column, total: str, tolerance: float = 0.02) -> DataFrame:
    """Groups whose recorded total differs from the sum of their factors' means."""
    own = mean_then_sum(details, keys, factor, value)
    return own.join(summaries.select(*keys, total), keys).filter(~is_close(F.col("calculated"), F.col(total), tolerance))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers all rows from 1 in an order: ranges are numbered by themselves, behind the rows of the ranges before.

    A written table fixes the ranges; one count for each of them goes through the driver. Rows that tie must not matter.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranks")
    before, total = [], 0
    for p, n in sorted(map(tuple, ranged.groupBy("__p").count().collect())):
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "__p int, __before long")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__before") + F.col("__own")).cast("int")).drop("__p", "__own", "__before")


def expected_rank(df: DataFrame, lot: list[str], total: str, name: str, out: str = "expected_rank") -> DataFrame:
    """1, 2, ... by falling total, ties by name, in each lot."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*lot).orderBy(F.col(total).desc(), F.col(name))))


def rank_mismatches(df: DataFrame, lot: list[str], total: str, name: str, rank: str) -> DataFrame:
    """Rows whose recorded rank isn't the expected one, in lots of at least two rows."""
    n = F.count("*").over(Window.partitionBy(*lot))
    return expected_rank(df.withColumn("__n", n), lot, total, name).filter(f"__n >= 2 AND {rank} IS NOT NULL AND {rank} <> expected_rank").drop("__n")


def candidate_mismatches(candidates: DataFrame, summaries: DataFrame, keys: list[str], rank: str, recorded: str) -> DataFrame:
    return candidates.join(summaries, keys).filter(F.col(rank) != F.col(recorded))


def conflicting_values(df: DataFrame, keys: list[str], value: str, digits: int) -> DataFrame:
    """Keys with two or more different rounded values: the values in order, and how many."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.round(value, digits).alias("__v")).distinct()
    return rows.groupBy(*keys).agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list("__v")).alias("values")).filter("n_values >= 2")


def leave_one_out(df: DataFrame, keys: list[str], score: str, max_score: str | None = None, *, floor: float = 5.0, share: float = 0.2) -> DataFrame:
    """Scores at least max(floor, share of the full score) off the mean of the group's other scores; groups of three or more."""
    w = Window.partitionBy(*keys)
    n, total, top = F.count(score).over(w), F.sum(score).over(w), F.max(score).over(w)
    full = F.coalesce(F.nullif(F.col(max_score), F.lit(0)), top) if max_score else top
    rows = df.withColumns({"__n": n, "peer_mean": (total - F.col(score)) / F.nullif(n - 1, F.lit(0)), "threshold": F.greatest(F.lit(floor), full * share)})
    return rows.withColumn("deviation", F.abs(F.col(score) - F.col("peer_mean"))).filter("__n >= 3 AND deviation >= threshold").drop("__n")


def mean_deviation(df: DataFrame, keys: list[str], score: str, *, floor: float = 3.0, share: float = 0.3) -> DataFrame:
    """Per group of two or more: mean, largest distance from it, and whether that passes max(floor, share of the mean)."""
    mean = F.avg(score).over(Window.partitionBy(*keys))
    rows = df.filter(F.col(score).isNotNull()).withColumn("__d", F.abs(F.col(score) - mean))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.max("__d").alias("max_deviation")).filter("n >= 2")
    return out.withColumn("warning", F.col("max_deviation") > F.greatest(F.lit(floor), F.abs("mean") * share))


def cross_lot_spread(df: DataFrame, key: str, lot: str, score: str, least: float = 10.0) -> DataFrame:
    """Keys whose scores differ by ``least`` or more over two or more lots."""
    rows = df.filter((F.col(lot) != "") & F.col(score).isNotNull())
    return rows.groupBy(key).agg((F.max(score) - F.min(score)).alias("spread"), F.count_distinct(lot).alias("n_lots")).filter(f"n_lots >= 2 AND spread >= {least}")


def price_progression(df: DataFrame, lot: str, price: str) -> DataFrame:
    """Per lot the arithmetic progression x < y < z of its distinct prices with the largest x, then the smallest y.

    Prices are whole cents, distinct before the shuffle. The search takes x from the largest down and ends at the
    first progression, so that a lot costs little more than its sort; it never makes all pairs.
    """

    def search(part: pd.DataFrame) -> pd.DataFrame:
        cents = np.sort(part["cents"].to_numpy())
        for i in range(len(cents) - 3, -1, -1):
            x, rest = cents[i], cents[i + 1 :]
            middle = rest[: np.searchsorted(rest, (x + cents[-1]) // 2, side="right")]
            at = np.searchsorted(rest, 2 * middle - x)
            hit = (at < len(rest)) & (rest[np.minimum(at, len(rest) - 1)] == 2 * middle - x)
            if hit.any():
                y = middle[hit.argmax()]
                return pd.DataFrame({"lot": pd.Series([part["lot"].iloc[0]], dtype=object), "first_cents": [x], "middle_cents": [y], "last_cents": [2 * y - x], "gap_cents": [y - x]})
        return pd.DataFrame({c: pd.Series(dtype=object if c == "lot" else "int64") for c in ("lot", "first_cents", "middle_cents", "last_cents", "gap_cents")})

    rows = df.filter(F.col(price).isNotNull()).select(F.col(lot).cast("string").alias("lot"), F.round(F.col(price) * 100).cast("long").alias("cents")).distinct()
    return rows.groupBy("lot").applyInPandas(search, "lot string, first_cents long, middle_cents long, last_cents long, gap_cents long")


def adjacent_gaps(df: DataFrame, lot: str, value: str, digits: int = 6) -> DataFrame:
    """Per lot of three or more different values: smallest and largest gap between neighbours, and whether all are equal."""
    rows = df.filter(F.col(value).isNotNull()).select(lot, value).distinct()
    gap = F.round(F.lead(value).over(Window.partitionBy(lot).orderBy(value)) - F.col(value), digits)
    out = rows.withColumn("__g", gap).groupBy(lot).agg(F.count("*").alias("n_values"), F.min("__g").alias("min_gap"), F.max("__g").alias("max_gap")).filter("n_values >= 3")
    return out.withColumn("regular", F.col("max_gap") - F.col("min_gap") <= 0.01)


def ranked_gaps(df: DataFrame, lot: list[str], total: str, name: str, digits: int = 2) -> DataFrame:
    """The gap from each total to the next lower one."""
    w = Window.partitionBy(*lot).orderBy(F.col(total).desc(), F.col(name))
    return df.withColumn("gap", F.round(F.col(total) - F.lead(total).over(w), digits)).filter("gap IS NOT NULL")
