"""Prefix sums in a total order without gathering the order in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, value: str, unit: str, ties: list[str], out: str, ranges: int = 4096) -> DataFrame:
    """``out``: the sum of ``value`` over the rows that precede in the order of ``unit``, then ``ties``.

    ``unit`` lies in [0, 1), so equal intervals of it are ranges in order; the
    sums of the ranges are accumulated apart (one row each), exact sums run
    inside a range.
    """
    cut = F.floor(F.col(unit) * ranges).cast("int")
    rows = df.withColumn("__cut", cut)
    sums = rows.groupBy("__cut").agg(F.sum(value).alias("__in"))
    before = Window.orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__cut", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__cut").orderBy(unit, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(sums), "__cut")
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__cut", "__base")
