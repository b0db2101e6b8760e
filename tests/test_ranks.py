"""Ranks over a whole relation, numbered range by range."""

import random

from pyspark.sql import functions as F

from sievemark.operators import scores


def test_global_rank_against_sorting(spark):
    draw = random.Random(3)
    rows = [(f"b{i:03}", draw.choice([1.5, 2.0, 7.25, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "bidder string, total double").repartition(5)
    keep = "spark.sql.adaptive.coalescePartitions.enabled"
    for on in ("true", "false"):
        spark.conf.set(keep, on)
        got = {r["bidder"]: r["r"] for r in scores.global_rank(df, [F.desc("total"), F.asc("bidder")], "r").collect()}
        assert got == {b: i for i, (b, _) in enumerate(sorted(rows, key=lambda r: (-(r[1] or -1), r[0])), 1)}
    spark.conf.unset(keep)
    assert scores.global_rank(df.limit(0), [F.asc("bidder")], "r").count() == 0
