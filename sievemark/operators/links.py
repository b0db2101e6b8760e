"""Links between suppliers and between documents, found by grouping values instead of comparing all pairs."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..exprs import compact, strip


def equal_attribute_pairs(df: DataFrame, row: str, attributes: list[str], within: list[str], name: str | None = None, *, least: int = 1) -> DataFrame:
    """(within..., a, b, n_equal): rows a < b of one task with at least ``least`` equal attributes, and how many.

    Blank values link nothing, nor do rows with equal ``name``. Rows meet by ``least`` attributes at once, so a value that
    very many share alone makes no pairs; with more than one set of as many attributes, a pair that meets twice counts once.
    """
    value = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    sets = [F.when(reduce(lambda x, y: x & y, [value(c).isNotNull() for c in own]), F.struct(F.lit(i).alias("i"), F.array(*map(value, own)).alias("values"))) for i, own in enumerate(combinations(attributes, least))]
    rows = df.select(*within, F.col(row).alias("__r"), F.col(name or row).alias("__n"), F.array(*map(value, attributes)).alias("__v"), F.explode(F.array_compact(F.array(*sets))).alias("__k"))
    a = rows.select(*within, "__k", F.col("__r").alias("a"), F.col("__n").alias("na"), F.col("__v").alias("va"))
    b = rows.select(*within, "__k", F.col("__r").alias("b"), F.col("__n").alias("nb"), F.col("__v").alias("vb"))
    equal = F.size(F.filter(F.zip_with("va", "vb", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x)).cast("long")
    both = a.join(b, [*within, "__k"]).filter("a < b AND na <> nb").select(*within, "a", "b", equal.alias("n_equal"))
    return both if len(sets) == 1 else both.distinct()


def shared_values(df: DataFrame, value: str, holder: str) -> DataFrame:
    """(value, n_holders): values that two or more holders have."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(holder).alias("n_holders")).filter("n_holders >= 2")


def long_lines(docs: DataFrame, doc: str, text: str, least: int = 24) -> DataFrame:
    """Distinct (doc, line): lines of at least ``least`` characters without their white space."""
    line = compact(strip("l"))
    return docs.select(F.col(doc).alias("doc"), F.explode(F.split(text, "\n")).alias("l")).select("doc", line.alias("line")).filter(F.length("line") >= least).distinct()


def similar_documents(docs: DataFrame, doc: str, text: str, *, lines: int = 3, characters: int = 80) -> DataFrame:
    """(a, b, n_shared, shared_chars, top_lines): documents that share at least ``lines`` lines no third one has.

    A line that exactly two documents have names their pair, so no document is joined with another: two aggregations,
    in proportion to the lines, and no limit on the number of documents.
    """
    pair = long_lines(docs, doc, text).groupBy("line").agg(F.count("*").alias("df"), F.min("doc").alias("a"), F.max("doc").alias("b")).filter("df = 2")
    order = F.array_sort(F.collect_list(F.struct((-F.length("line")).alias("n"), F.col("line").alias("line"))))
    out = pair.groupBy("a", "b").agg(F.count("*").alias("n_shared"), F.sum(F.length("line")).alias("shared_chars"), F.transform(F.slice(order, 1, 5), lambda x: x["line"]).alias("top_lines"))
    return out.filter(f"n_shared >= {lines} AND shared_chars >= {characters}")


def sequence_ratio(pairs: DataFrame, a: str, b: str, out: str = "ratio") -> DataFrame:
    """Ratcliff-Obershelp similarity of two text columns; for the few pairs that are left, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, s or "", t or "").ratio() for s, t in zip(x, y, strict=True)])

    return pairs.withColumn(out, ratio(a, b))


#: Most copies of a row that one task makes in a go.
RUN = 10_000


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` (1 or more) says, without that column; the copies are dealt over all tasks."""
    own = [c for c in rows.columns if c != times]
    runs = rows.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / RUN))))
    dealt = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN).cast("long"), F.col(times) - F.col("__run") * RUN)))).select(*own)
