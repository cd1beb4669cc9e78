"""Checks and measures of what crosses from one split into another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def straddling(rows: DataFrame, entry_split: DataFrame, key: str, entry: str = "entry_id") -> DataFrame:
    """``(key, splits)`` of the keys whose entries lie in several splits; computed from keys and splits alone."""
    joined = rows.select(entry, key).distinct().join(entry_split.select(entry, "split"), entry)
    return joined.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def assert_no_leakage(entry_keys: DataFrame, entry_split: DataFrame, family_rows: DataFrame | None = None) -> None:
    """Raise with the first key or family that straddles splits."""
    for rows, key in ((entry_keys, "raw_key"), (family_rows, "family")):
        if rows is None:
            continue
        bad = straddling(rows, entry_split, key).orderBy(key).limit(1).collect()
        if bad:
            raise AssertionError(f"{key} {bad[0][key]!r} lies in {' and '.join(bad[0]['splits'])}")


def seen_in_train(labels: DataFrame, entry_split: DataFrame, by: tuple[str, ...] = ("family",)) -> DataFrame:
    """Distinct values of ``by`` that a train entry has."""
    return labels.join(entry_split.where("split = 'train'").select("entry_id"), "entry_id", "left_semi").select(*by).distinct()


def novelty(labels: DataFrame, entry_split: DataFrame) -> DataFrame:
    """``(entry_id, split, families, novel)``: held out, and none of its families is in train."""
    seen = seen_in_train(labels, entry_split).withColumn("seen", F.lit(True))
    rows = labels.join(entry_split.select("entry_id", "split"), "entry_id").join(seen, "family", "left")
    any_seen = F.bool_or(F.coalesce("seen", F.lit(False)))
    out = rows.groupBy("entry_id", "split").agg(F.array_sort(F.collect_set("family")).alias("families"), any_seen.alias("any_seen"))
    return out.select("entry_id", "split", "families", ((F.col("split") != "train") & ~F.col("any_seen")).alias("novel"))


def family_groups(labels: DataFrame, entry_split: DataFrame) -> DataFrame:
    """``(family, novel, test_entries)`` of the families that test has."""
    seen = seen_in_train(labels, entry_split).withColumn("seen", F.lit(True))
    test = labels.join(entry_split.where("split = 'test'").select("entry_id"), "entry_id", "left_semi")
    out = test.groupBy("family").agg(F.array_sort(F.collect_set("entry_id")).alias("test_entries")).join(seen, "family", "left")
    return out.select("family", F.col("seen").isNull().alias("novel"), "test_entries")


def benchmark_summary(labels: DataFrame, entry_split: DataFrame) -> DataFrame:
    """One row of counters over the test split."""
    test = F.col("split") == "test"
    per = novelty(labels, entry_split).agg(F.count_if(test).alias("n_test_classified"), F.count_if(test & F.col("novel")).alias("n_test_novel_fold"))
    groups = family_groups(labels, entry_split).agg(F.count("*").alias("n_test_distinct_folds"), F.count_if("novel").alias("n_test_novel_folds"))
    return entry_split.agg(F.count_if(test).alias("n_test")).crossJoin(per).crossJoin(groups)


def certified_novel(labels: DataFrame, entry_split: DataFrame) -> DataFrame:
    """Held-out entries that some authority classifies and of whose families, by any authority, train has none."""
    return novelty(labels, entry_split).where("novel").select("entry_id", "split")


def leak_rate(entries: DataFrame, group: Column, leaky: str = "leaky") -> DataFrame:
    """``(bin, n, leaking, pct)`` of held-out rows by a grouping expression."""
    out = entries.groupBy(group.alias("bin")).agg(F.count("*").alias("n"), F.count_if(leaky).alias("leaking"))
    return out.withColumn("pct", 100.0 * F.col("leaking") / F.col("n"))


def pool_sizes(labels: DataFrame, entry_split: DataFrame) -> DataFrame:
    """``(entry_id, pool)``: train entries that share a family with each held-out entry that has families.

    Entries with the very same families are one *set* of families with a count,
    on either side, so pairs are pairs of distinct sets, never of entries; a
    held-out set of one family needs that family's count only.
    """
    split = labels.join(entry_split.select("entry_id", "split"), "entry_id").groupBy("entry_id").agg(F.array_sort(F.collect_set("family")).alias("families"), F.first("split").alias("split"))
    split = split.withColumn("set", F.md5(F.array_join(F.transform("families", lambda f: f.cast("string")), "\x1f")))
    sets = lambda rows: rows.groupBy("set").agg(F.first("families").alias("families"), F.count("*").alias("n"))
    held = split.where("split <> 'train'")
    train = sets(split.where("split = 'train'")).select(F.col("set").alias("other"), "n", F.explode("families").alias("family"))
    asked = sets(held).select("set", F.size("families").alias("k"), F.explode("families").alias("family"))
    counts = train.groupBy("family").agg(F.sum("n").alias("pool"))
    single = asked.where("k = 1").join(counts, "family", "left").select("set", "pool")
    several = asked.where("k > 1").join(train, "family").select("set", "other", "n").distinct().groupBy("set").agg(F.sum("n").alias("pool"))
    pools = single.unionByName(several)
    return held.select("entry_id", "set").join(pools, "set", "left").select("entry_id", F.coalesce("pool", F.lit(0)).alias("pool"))


def pool_statistics(pools: DataFrame) -> DataFrame:
    """Median, mean, the element at index ``9 * n // 10`` of the order, and zeros."""
    n = pools.count()
    counts = pools.groupBy("pool").agg(F.count("*").alias("c"))
    # Order statistics from counts by value: the list itself is never sorted.
    from pyspark.sql import Window

    upto = F.sum("c").over(Window.orderBy("pool"))
    ranked = counts.withColumn("upto", upto)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("pool")))
    low, high = max(0, (n - 1) // 2), n // 2
    return ranked.agg(
        F.lit(n).cast("long").alias("n"), ((at(low) + at(high)) / 2.0).alias("median"), (F.sum(F.col("pool") * F.col("c")) / F.sum("c")).alias("mean"),
        at(9 * n // 10).alias("p90"), F.coalesce(F.sum(F.when(F.col("pool") == 0, F.col("c"))), F.lit(0)).alias("zeros"),
    )


def co_occupancy(entry_keys: DataFrame, entry_split: DataFrame) -> DataFrame:
    """``(split, held, leaky)``: held-out entries one of whose keys a train entry has too."""
    rows = entry_keys.join(entry_split.select("entry_id", "split"), "entry_id")
    train = rows.where("split = 'train'").select("raw_key").distinct().withColumn("hit", F.lit(True))
    held = rows.where("split <> 'train'").join(train, "raw_key", "left").groupBy("split", "entry_id").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("leaky"))
    return held.groupBy("split").agg(F.count("*").alias("held"), F.count_if("leaky").alias("leaky"))


def bridge_leakage(entry_component: DataFrame, entry_split: DataFrame) -> DataFrame:
    """The same over components instead of keys: what chains of shared keys connect to train."""
    rows = entry_component.select("entry_id", F.col("component").alias("raw_key"))
    return co_occupancy(rows, entry_split)


def pair_context(labels: DataFrame, entry_split: DataFrame) -> DataFrame:
    """``(split, pairs, seen)``: distinct (family, class) pairs of held-out entries, and those that train has."""
    rows = labels.join(entry_split.select("entry_id", "split"), "entry_id")
    train = rows.where("split = 'train'").select("family", "class").distinct().withColumn("hit", F.lit(True))
    held = rows.where("split <> 'train'").select("split", "family", "class").distinct().join(train, ["family", "class"], "left")
    return held.groupBy("split").agg(F.count("*").alias("pairs"), F.count("hit").alias("seen"))


def moved_entries(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row ``(moved, into_train, out_of_train)`` of two assignments' common entries."""
    rows = before.select("entry_id", F.col("split").alias("was")).join(after.select("entry_id", F.col("split").alias("now")), "entry_id").where("was <> now")
    return rows.agg(F.count("*").alias("moved"), F.count_if(F.col("now") == "train").alias("into_train"), F.count_if(F.col("was") == "train").alias("out_of_train"))


def id_drift(before: DataFrame, after: DataFrame, entry: str = "entry_id") -> DataFrame:
    """``(entry, change)`` of the entries that one side alone has."""
    added = after.select(entry).distinct().join(before, entry, "left_anti").withColumn("change", F.lit("added"))
    removed = before.select(entry).distinct().join(after, entry, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)
