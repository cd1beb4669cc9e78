"""Pairs of points within a distance, by cells of a grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def radius_join(left: DataFrame, right: DataFrame, axes: tuple[str, ...], radius: float) -> DataFrame:
    """Rows of both sides at most ``radius`` apart, with ``distance``; axes are columns of both.

    A cell is as wide as the radius, so a point's neighbours are in its own
    cell or one next to it: ``right`` is repeated for the cells around it and
    joined with ``left`` on the cell, an equi-join. Points with a null axis
    have no neighbours. Columns of ``right`` get the prefix ``r_``.
    """
    cell = F.array(*[F.floor(F.col(a) / radius) for a in axes])
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = F.array(F.array().cast("array<bigint>"))
    for k in range(len(axes)):
        own = F.get(cell, F.lit(k))
        around = F.flatten(F.transform(around, lambda head: F.transform(steps, lambda s: F.concat(head, F.array((own + s).cast("bigint"))))))  # noqa: B023
    known = reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a in axes])
    mine = left.where(known).withColumn("__cell", cell)
    theirs = right.where(known).withColumn("__cell", F.explode(around))
    theirs = theirs.select("__cell", *[F.col(c).alias(f"r_{c}") for c in right.columns])
    squared = reduce(lambda a, b: a + b, [(F.col(a) - F.col(f"r_{a}")) * (F.col(a) - F.col(f"r_{a}")) for a in axes])
    joined = mine.join(theirs, "__cell").withColumn("distance", F.sqrt(squared)).where(F.col("distance") <= radius)
    return joined.drop("__cell")
