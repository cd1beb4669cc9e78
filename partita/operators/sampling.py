"""Deterministic one-per-group samples and weights against redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.hashing import rank
from partita.session import shuffle_partitions, stage_table


def sample_one_per_group(rows: DataFrame, group: str, seed: int, entry: str = "entry_id", hash_name: str = "md5") -> DataFrame:
    """``(group, entry, group_rank)``: the entry of least rank; sort by ``group_rank``, then entry, for the sample's order.

    The least is an aggregate with map-side combine, so a group of any size
    costs one row a task.
    """
    least = F.min(F.struct(rank(seed, F.col(entry), hash_name).alias("r"), F.col(entry).alias("e")))
    picked = rows.groupBy(group).agg(least.alias("x")).select(group, F.col("x.e").alias(entry))
    return picked.withColumn("group_rank", rank(seed, F.col(group), hash_name))


def redundancy_weights(rows: DataFrame, group: str, entry: str = "entry_id") -> DataFrame:
    """``(entry, weight)``: one over the size of the group, so that weights add up to the number of groups."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    return rows.join(sizes, group).select(entry, (1.0 / F.col("n")).alias("weight"))


def stride_sample(rows: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows at equal steps of the order: those at ``int(i * step)``.

    Rows are sorted by ranges over the cluster; a row's place is its place in
    its range and the rows of the ranges before, one number for each range.
    """
    total = rows.count()
    if n >= total:
        return rows
    step = total / n
    ranged = stage_table(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), order).withColumn("__part", F.spark_partition_id()), "ranges")
    across = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("__first"))
    at = F.col("__first") + F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    # A place is taken if the step next to it lands on it; two are tried, since floats round.
    near = F.floor(F.col("__at") / step)
    taken = (F.floor(near * step) == F.col("__at")) | (F.floor((near + 1) * step) == F.col("__at")) & (near + 1 < n)
    return ranged.join(F.broadcast(first), "__part").withColumn("__at", at).where(taken).select(*rows.columns)


def seeded_sample(rows: DataFrame, entry: str, n: int, seed: int, hash_name: str = "md5") -> DataFrame:
    """``n`` rows of least rank: the same in every run and for any partitioning."""
    return rows.withColumn("__r", rank(seed, F.col(entry), hash_name)).orderBy("__r", entry).limit(n).drop("__r")
