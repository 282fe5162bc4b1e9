"""Pairs of two sides of which one or both are too large to be sent everywhere."""

from pyspark.sql import functions as F

from loamline.operators import pairing
from loamline.session import cut_lineage


def test_copies_of_a_large_side_are_not_broadcast(spark):
    left = cut_lineage(spark.range(400).select((F.col("id") % 2).alias("g"), F.col("id").alias("l")))
    right = cut_lineage(spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("r")))
    both = pairing.pair_rows(left, right, ["g"], limit=200, width=12)
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
    one = pairing.pair_rows(left.where("l < 150"), right, ["g"], limit=200, width=12)
    assert "BuildLeft" in one._jdf.queryExecution().executedPlan().toString()
    expect = sorted((l % 2, l, r) for l in range(400) for r in range(300) if l % 2 == r % 3)
    assert sorted(map(tuple, both.collect())) == expect
    assert sorted(map(tuple, one.collect())) == [row for row in expect if row[1] < 150]
