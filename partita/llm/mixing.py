"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: a budget of words is shared over the sources by weight; a source's
target stops at ``max_epochs`` times its size and the excess is shared again.
Whole epochs come first. What is left of a target is filled with documents in
the order of their exponential keys ``-ln(u) / w`` (``u`` a hash of the
identifier, ``w`` the quality weight), so heavier documents come earlier; the
document at which the budget ends gives only the words that still fit.

The order within a source is never gathered in one task: keys are dealt into
ranges of like numbers of rows whatever the weights are, the sums of the ranges are accumulated (one row per source and range),
and exact prefix sums run inside each range only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.session import shuffle_partitions, stage_table

#: The weights that sources take in turn, and the shares of the contract.
WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2


def n_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, salt: str = "mix") -> Column:
    """A uniform number in (0, 1) from a row's key, the same in every rerun."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def letter_share(text: Column) -> Column:
    """The default quality weight: 0.1 and the share of characters that are letters, of any script."""
    t = F.coalesce(text, F.lit(""))
    return F.lit(0.1) + F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) / F.greatest(F.length(t), F.lit(1))


def _in_turn(by: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds the weights that sources take in turn, in the order of their code points, null last.

    Sources are sorted by ranges over the cluster; a range's rank begins after
    the sources of all ranges before it, one number for each range.
    """
    ranged = by.repartitionByRange(shuffle_partitions(by.sparkSession), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = stage_table(ranged, "sources")
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranged.withColumn("rank", rank).join(F.broadcast(first), "part")
    return ranked.select("source", "source_size", F.element_at(turn, ((F.col("first") + F.col("rank")) % len(weights) + 1).cast("int")).alias("weight"))


def source_targets(sizes: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``: one row per source.

    What each unit of weight gets is found by sharing again: sources that it
    puts above their cap get their cap, and what is left is shared by the
    others, until none is above. Each round is one aggregate over the sources.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = stage_table(_in_turn(by, weights).withColumn("cap", max_epochs * F.col("source_size").cast("double")), "targets")
    whole = by.agg(F.sum("source_size")).first()[0] or 0
    budget, level = budget_share * float(whole), -1.0
    while True:
        over = F.col("cap") / F.col("weight") < level
        capped, weight = by.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not weight:  # all are at their caps, or there is no source
            level = math.inf
            break
        then, level = level, (budget - capped) / weight
        if level <= then:
            break
    return by.select("source", "source_size", F.when(F.col("cap") < F.col("weight") * level, F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def _share_below(sized: DataFrame) -> Column:
    """About the share of all rows whose key is below ``key``: keys of one weight are exponential, and weights have a histogram of 32 steps at most.

    It rises with the key whatever the histogram says, so it cuts the keys'
    order into ranges; how good it is only decides how even they are.
    """
    step = F.round(4 * F.log2("weight")).cast("int").alias("step")
    counts = sized.groupBy(step).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "step").limit(32).collect()
    total = sum(r["n"] for r in counts) or 1
    parts = [F.lit(r["n"] / total) * (1 - F.exp(-F.col("key") * (2.0 ** (r["step"] / 4)))) for r in counts]
    return reduce(Column.__add__, parts, F.lit(0.0))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    budget_share: float = BUDGET_SHARE,
    max_epochs: float = MAX_EPOCHS,
    weights: tuple[int, ...] = WEIGHTS,
    salt: str = "mix",
    rows_per_range: int | None = None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, epochs, taken`` for every row.

    Null or empty texts have size 0 and are taken with 0 words. A null source
    is a source of its own, last in order. Rows without an identifier take
    ``u`` from their text; ties of keys fall to the smaller identifier, then size. A repeated row is
    one more document. A sum of sizes of 0 gives targets of 0. Columns other
    than those named are ignored; an empty table gives no rows. A weight that is
    null, not a number or not above 0 counts as 1e-9, an infinite one as 1e9.
    """
    text = F.col(text_col).cast("string")
    given = (weight if weight is not None else letter_share(text)).cast("double")
    quality = F.when(given > 1e-9, F.least(F.when(F.isnan(given), 1e-9).otherwise(given), F.lit(1e9))).otherwise(1e-9).alias("weight")
    own = F.coalesce(F.col(id_col).cast("string"), F.md5(F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))))
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), quality, (-F.log(uniform(own, salt))).alias("key"))
    sized = stage_table(sized.withColumn("key", F.col("key") / F.col("weight")), "sizes")
    targets = source_targets(sized, budget_share, max_epochs, weights)
    # By default as many ranges as rows in a range, and 4096 at most.
    rows = sized.count()
    ranges = max(1, min(4096, rows // (rows_per_range or max(1000, math.isqrt(rows)))))
    cut = F.least(F.floor(_share_below(sized) * ranges).cast("int"), F.lit(ranges - 1))
    keyed = sized.withColumn("cut", cut).drop("weight")
    per_cut = keyed.groupBy("source", "cut").agg(F.sum("size").alias("in_cut"))
    by_cut = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    per_cut = per_cut.withColumn("base", F.coalesce(F.sum("in_cut").over(by_cut), F.lit(0)))
    per_cut = per_cut.join(targets, per_cut["source"].eqNullSafe(targets["source"])).select(per_cut["source"].alias("source"), "cut", "base", "source_size", "target")
    # A tag that is never null stands for the source in the join.
    tag = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    inside = Window.partitionBy("tag", "cut").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.withColumn("tag", tag).join(per_cut.withColumn("tag", tag).drop("source"), ["tag", "cut"])
    joined = joined.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.least("size", F.greatest(F.lit(0), rest - F.col("before")))
    return joined.withColumn("epochs", epochs).select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).alias("taken"))
