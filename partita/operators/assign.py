"""Assignment of whole components to train, val and test."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.config import DOMINANT_SHARE, SPLITS, Fractions
from partita.functions.hashing import bucket
from partita.operators.prefix import running_before
from partita.session import checkpointed

#: Of several pins the most held out one counts.
PRECEDENCE = ("test", "val", "train")


def component_sizes(entry_component: DataFrame) -> DataFrame:
    return entry_component.groupBy("component").agg(F.count("*").alias("size"))


def with_bucket(sizes: DataFrame, salt: str, hash_name: str = "md5") -> DataFrame:
    return sizes.withColumn("bucket", bucket(salt, F.col("component"), hash_name))


def by_fractions(unit: Column, fractions: Fractions) -> Column:
    return F.when(unit < fractions.train, "train").when(unit < fractions.train + fractions.val, "val").otherwise("test")


def pins(entry_keys: DataFrame, entry_component: DataFrame, registry: DataFrame) -> DataFrame:
    """``(component, pin)``: a pin on any key that the component covers; of several the most held out."""
    order = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("split"))
    held = entry_keys.join(entry_component, "entry_id").select("component", "raw_key").distinct().join(registry.select("raw_key", "split"), "raw_key")
    return held.groupBy("component").agg(F.min_by("split", order).alias("pin"))


def assign_hash(sized: DataFrame, fractions: Fractions) -> DataFrame:
    """``(component, split)`` from ``(component, size, bucket, pin)``; pins first, the rest by their bucket."""
    return sized.select("component", F.coalesce("pin", by_fractions(F.col("bucket"), fractions)).alias("split"))


def assign_balanced(sized: DataFrame, fractions: Fractions) -> tuple[DataFrame, DataFrame]:
    """Pins, then dominant components to train, then test and val up to their targets in bucket order.

    Since sizes are positive, running totals only grow, so what goes to test is
    a prefix of the order and what goes to val a prefix of the rest. Returns the
    assignment and one row ``(n_capped, gap_val, gap_test)``.
    """
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    held = {r["pin"]: r["n"] for r in sized.where("pin is not null").groupBy("pin").agg(F.sum("size").alias("n")).collect()}
    target = {"test": fractions.test * total, "val": fractions.val * total}
    dominant = F.col("size") > DOMINANT_SHARE * total
    fixed = sized.withColumn("split", F.when(F.col("pin").isNotNull(), F.col("pin")).when(dominant, "train"))
    free = running_before(fixed.where("split is null"), "size", "bucket", ["component"], "before")
    free = free.withColumn("split", F.when(F.col("before") + held.get("test", 0) < target["test"], "test"))
    rest = running_before(free.where("split is null").drop("before"), "size", "bucket", ["component"], "before")
    rest = rest.withColumn("split", F.when(F.col("before") + held.get("val", 0) < target["val"], "val").otherwise("train"))
    columns = ("component", "size", "split")
    parts = [fixed.where("split is not null"), free.where("split is not null"), rest]
    out = checkpointed(parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns)))
    gap = lambda s: F.lit(target[s]) - F.coalesce(F.sum(F.when(F.col("split") == s, F.col("size"))), F.lit(0))
    gaps = [F.when(gap(s) > 0.5, gap(s).cast("long")).otherwise(0).alias(f"gap_{s}") for s in ("val", "test")]
    capped = fixed.where(dominant & F.col("pin").isNull()).agg(F.count("*").alias("n_capped"))
    return out.select("component", "split"), capped.crossJoin(out.agg(*gaps))


def assign_maximal(sized: DataFrame, fractions: Fractions) -> tuple[DataFrame, DataFrame]:
    """The holdout is what fits under its ceiling; train gets the rest.

    Pinned components come first, then all others, each in bucket order. A
    component that would overflow the ceiling goes to train and is passed over,
    so what is held out is no prefix: the fold runs in order over components
    (never entries), streamed through one task with three numbers of state.
    Those too large to ever fit are settled before it. Returns the assignment
    and one row ``(n_capped)``.
    """
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ceiling = (fractions.val + fractions.test) * total
    to_train = F.col("size") > ceiling
    settled = sized.where(to_train | F.coalesce(F.col("pin") == "train", F.lit(False))).select("component", F.lit("train").alias("split"), (to_train & ~F.coalesce(F.col("pin") == "train", F.lit(False))).alias("capped"))
    order = sized.where(~to_train & F.coalesce(F.col("pin") != "train", F.lit(True))).select("component", "size", "pin", "bucket", F.col("pin").isNull().alias("late"))
    order = order.repartition(1).sortWithinPartitions("late", "bucket", "component").select("component", "size", "pin")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {"val": 0, "test": 0}
        for frame in frames:
            split, capped = [], []
            for size, pin in zip(frame["size"], frame["pin"], strict=True):
                over = held["val"] + held["test"] + size > ceiling
                side = "train" if over else pin or ("val" if held["val"] <= held["test"] else "test")
                if not over:
                    held[side] += size
                split.append(side)
                capped.append(over)
            yield pd.DataFrame({"component": frame["component"], "split": split, "capped": capped})

    kind = sized.schema["component"].dataType.simpleString()
    out = checkpointed(settled.unionByName(order.mapInPandas(fold, f"component {kind}, split string, capped boolean")))
    return out.select("component", "split"), out.agg(F.count_if("capped").alias("n_capped"))


def enforce_minimums(assigned: DataFrame, sized: DataFrame, class_counts: DataFrame, minimums: dict[str, int], cap_share: float | None) -> tuple[DataFrame, dict[str, int]]:
    """Recruit whole components into test until each class has its floor; classes in alphabetical order.

    ``class_counts`` is ``(component, class, n)``. Smallest components first,
    then by bucket; pinned ones and those above ``cap_share`` of all entries
    stay where they are. Returns the assignment and what no supply could meet.
    """
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shortfalls: dict[str, int] = {}
    now = assigned
    for label in sorted(k for k, v in minimums.items() if v > 0):
        counts = class_counts.where(F.col("class") == label).select("component", "n")
        have = now.where("split = 'test'").join(counts, "component").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        open_ = now.where("split <> 'test'").join(counts, "component").join(sized.select("component", "size", "bucket", "pin"), "component").where("pin is null and n > 0")
        if cap_share is not None:
            open_ = open_.where(F.col("size") <= cap_share * total)
        # A unit order by size, then bucket: each size has the stretch between its logarithm and the next one's.
        low, high = F.log2("size") / 64, F.log2(F.col("size") + 1) / 64
        unit = F.least(low + F.col("bucket") * (high - low), high)
        ordered = running_before(open_.withColumn("unit", unit), "n", "unit", ["size", "bucket", "component"], "before")
        recruited = checkpointed(ordered.where(F.col("before") + have < minimums[label]).select("component", "n"))
        got = recruited.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if have + got < minimums[label]:
            shortfalls[label] = minimums[label] - have - got
        mark = recruited.select("component", F.lit(True).alias("recruited"))
        now = checkpointed(now.join(mark, "component", "left").select("component", F.when(F.col("recruited"), "test").otherwise(F.col("split")).alias("split")))
    return now, shortfalls


def overridden_pins(assigned: DataFrame, entry_keys: DataFrame, entry_component: DataFrame, registry: DataFrame) -> DataFrame:
    """One row ``(pins, entries)``: prior pins that the assignment breaks, and entries of the components concerned."""
    key_component = entry_keys.join(entry_component, "entry_id").select("raw_key", "component").distinct()
    broken = registry.select("raw_key", F.col("split").alias("prior")).join(key_component, "raw_key").join(assigned, "component").where("prior <> split")
    sizes = component_sizes(entry_component)
    entries = broken.select("component").distinct().join(sizes, "component").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("entries"))
    return broken.agg(F.count("*").alias("pins")).crossJoin(entries)


def entry_splits(entry_component: DataFrame, assigned: DataFrame) -> DataFrame:
    return entry_component.join(assigned, "component").select("entry_id", "component", "split")


def split_counts(entry_split: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """A row for each split, empty ones too: entries, components, and distinct sequence groups if given."""
    spark = entry_split.sparkSession
    aggregates = [F.count("entry_id").alias("entries"), F.countDistinct("component").alias("components")]
    rows = entry_split
    if groups is not None:
        rows = rows.join(groups, "entry_id", "left")
        aggregates.append(F.countDistinct("sequence_group").alias("sequence_groups"))
    found = rows.groupBy("split").agg(*aggregates)
    every = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    return every.join(found, "split", "left").na.fill(0)
