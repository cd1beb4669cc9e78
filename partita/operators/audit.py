"""Audits of partitions that others have published, and of coverage and redundancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.functions.text import longest_run
from partita.operators.contraction import contracted, labels_across, named, shared_keys, spanning


def list_sizes(lists: DataFrame) -> DataFrame:
    """``(list, total, distinct, duplicates)`` from ``(list, id)``."""
    out = lists.groupBy("list").agg(F.count("*").alias("total"), F.countDistinct("id").alias("distinct_ids"))
    return out.withColumn("duplicates", F.col("total") - F.col("distinct_ids"))


def list_overlaps(lists: DataFrame) -> DataFrame:
    """``(list_a, list_b, shared)`` for every pair of lists, zeros too; through each id's lists, never through pairs of ids."""
    held = lists.select("list", "id").distinct()
    per = held.groupBy("id").agg(F.array_sort(F.collect_set("list")).alias("ls")).where(F.size("ls") > 1)
    pairs = F.flatten(F.transform("ls", lambda a: F.transform(F.filter("ls", lambda b: b > a), lambda b: F.struct(a.alias("list_a"), b.alias("list_b")))))
    found = per.select(F.explode(pairs).alias("p")).groupBy("p.list_a", "p.list_b").agg(F.count("*").alias("shared"))
    # The names of the lists are few; their pairs fill in the zeros.
    names = F.array_sort(F.collect_set("list"))
    every = held.agg(names.alias("ls")).select(F.explode(pairs).alias("p")).select("p.list_a", "p.list_b")
    return every.join(found, ["list_a", "list_b"], "left").na.fill(0, ["shared"])


def straddlers(lists: DataFrame) -> DataFrame:
    """``(id, lists, rows)`` of the ids that several lists have."""
    return lists.groupBy("id").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.count("*").alias("rows")).where(F.size("lists") > 1)


def rollup_precedence(rows: DataFrame, group: str, label: str, precedence: tuple[str, ...]) -> DataFrame:
    """``(group, label, straddles)``: the label that comes first in the precedence."""
    order = F.array_position(F.array(*map(F.lit, precedence)), F.col(label))
    return rows.groupBy(group).agg(F.min_by(label, order).alias(label), (F.countDistinct(label) > 1).alias("straddles"))


def last_label(rows: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """The label of the last list that has the group's id."""
    return rows.groupBy(group).agg(F.max_by(label, F.struct(order, label)).alias(label))


def coverage(rows: DataFrame, split: str, family: str, entry: str = "entry_id") -> DataFrame:
    """Entries, classified ones and distinct families by split; null families are unclassified."""
    per = rows.groupBy(split, entry).agg(F.count(family).alias("k"))
    entries = per.groupBy(split).agg(F.count("*").alias("entries"), F.count_if(F.col("k") > 0).alias("classified"))
    kinds = rows.groupBy(split).agg(F.countDistinct(family).alias("families"))
    return entries.join(kinds, split).withColumn("unclassified", F.col("entries") - F.col("classified"))


def redundancy(rows: DataFrame, split: str, group: str) -> DataFrame:
    """Entries, distinct groups, share of redundant entries, and the largest group, by split."""
    sizes = rows.groupBy(split, group).agg(F.count("*").alias("n"))
    out = sizes.groupBy(split).agg(F.sum("n").alias("entries"), F.count("*").alias("distinct_groups"), F.max("n").alias("largest"))
    return out.withColumn("redundancy", (F.col("entries") - F.col("distinct_groups")) / F.col("entries"))


def fan_out(rows: DataFrame, item: str, target: str) -> DataFrame:
    """``(item, fan_out)``: distinct targets of each item."""
    return rows.groupBy(item).agg(F.countDistinct(target).alias("fan_out"))


def fan_out_by_threshold(rows: DataFrame, item: str, target: str, length: Column, thresholds: list[int]) -> DataFrame:
    """``(threshold, items, max_fan_out)`` over the items at least that long; one aggregation for all thresholds."""
    per = rows.groupBy(item).agg(F.countDistinct(target).alias("fan_out"), F.max(length).alias("len"))
    met = per.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("len") >= t)))
    found = met.groupBy("threshold").agg(F.count("*").alias("items"), F.max("fan_out").alias("max_fan_out"))
    every = rows.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")
    return every.join(found, "threshold", "left").na.fill(0)


def top_k(rows: DataFrame, key: str, k: int, examples: str | None = None, n_examples: int = 8) -> DataFrame:
    """The ``k`` most frequent keys, ties by key, with their first examples; only those are ever gathered."""
    top = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)
    if not examples:
        return top
    held = rows.join(F.broadcast(top.select(key)), key, "left_semi").select(key, examples).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy(examples))
    first = held.withColumn("__place", place).where(F.col("__place") <= n_examples).groupBy(key).agg(F.array_sort(F.collect_list(examples)).alias("examples"))
    return top.join(first, key, "left").orderBy(F.desc("n"), key)


def drift(counts: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """``(split, pct, target_pct, drift)`` in percentage points, from ``(split, entries)``."""
    total = counts.agg(F.sum("entries").alias("total"))
    target = F.coalesce(*[F.when(F.col("split") == s, F.lit(100.0 * f)) for s, f in fractions.items()])
    out = counts.select("split", "entries").crossJoin(total).select("split", (100.0 * F.col("entries") / F.col("total")).alias("pct"), target.alias("target_pct"))
    return out.withColumn("drift", F.col("pct") - F.col("target_pct"))


def class_counts(rows: DataFrame, split: str, label: str, entry: str = "entry_id") -> DataFrame:
    """Distinct entries by split and class, with a row for each class over all splits (split null)."""
    grouped = rows.select(split, label, entry).distinct().cube(split, label).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return grouped.where("g in (0, 2)").drop("g")


def satisfies(rows: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    """For each group, how many rows satisfy each named predicate."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in flags.items()])


def novelty_by_class(labels: DataFrame, entry_split: DataFrame, classes: DataFrame, methods: list[str]) -> DataFrame:
    """``(method, class, split, seen, novel, unclassified)`` of held-out entries, by class and over all (class null).

    ``labels`` is ``(entry_id, method, family)``. An entry is seen by a method if
    train has one of its families, novel if train has none, unclassified if it
    has none; ``combined`` takes the families of all methods together.
    """
    every = labels.select("entry_id", "method", "family").unionByName(labels.select("entry_id", F.lit("combined").alias("method"), F.concat_ws(":", "method", "family").alias("family"))).distinct()
    rows = every.join(entry_split.select("entry_id", "split"), "entry_id")
    train = rows.where("split = 'train'").select("method", "family").distinct().withColumn("hit", F.lit(True))
    judged = rows.where("split <> 'train'").join(train, ["method", "family"], "left").groupBy("entry_id", "method").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("seen"))
    asked = entry_split.where("split <> 'train'").select("entry_id", "split", F.explode(F.array(*map(F.lit, [*methods, "combined"]))).alias("method")).join(judged, ["entry_id", "method"], "left")
    named = asked.join(classes.select("entry_id", "class").distinct(), "entry_id", "left")
    count = [F.count_if(F.col("seen")).alias("seen"), F.count_if(~F.col("seen")).alias("novel"), F.count_if(F.col("seen").isNull()).alias("unclassified")]
    by_class = named.where("class is not null").groupBy("method", "class", "split").agg(*count)
    return by_class.unionByName(asked.groupBy("method", "split").agg(*count).select("method", F.lit(None).cast("string").alias("class"), "split", "seen", "novel", "unclassified"))


def class_contamination(tiers: DataFrame, published: DataFrame, k: int = 6) -> DataFrame:
    """``(class, entries, functional, other, reasons)`` of published class lists ``(entry_id, class)``.

    An entry is functional if one of its components functionally has the class;
    ``reasons`` are the ``k`` most frequent reasons of the class's components of the others.
    """
    rows = published.select("entry_id", "class").distinct().join(tiers.select("entry_id", "tier", "reason", "would_be"), "entry_id", "left")
    mine = F.col("would_be") == F.col("class")
    judged = rows.groupBy("class", "entry_id").agg(F.coalesce(F.bool_or(mine & (F.col("tier") == "functional")), F.lit(False)).alias("functional"))
    counts = judged.groupBy("class").agg(F.count("*").alias("entries"), F.count_if("functional").alias("functional"), F.count_if(~F.col("functional")).alias("other"))
    why = rows.where(mine).join(judged.where("not functional"), ["class", "entry_id"], "left_semi").groupBy("class", "reason").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "reason"))
    top = why.withColumn("place", place).where(F.col("place") <= k).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("place", "reason", "n"))).alias("reasons"))
    return counts.join(top, "class", "left")


def tag_audit(sequences: DataFrame, suspects: DataFrame, runs: tuple[int, ...] = (6, 5, 4), residue: str = "H") -> DataFrame:
    """``(min_run, entries, tagged, fraction)``: of the suspect entries, those with a chain whose longest run reaches each length."""
    longest = sequences.groupBy("entry_id").agg(F.max(longest_run(F.col("seq"), residue)).alias("run"))
    rows = suspects.select("entry_id").distinct().join(longest, "entry_id", "left").select(F.coalesce("run", F.lit(0)).alias("run"))
    counted = rows.agg(F.count("*").alias("entries"), *[F.count_if(F.col("run") >= r).alias(f"r{r}") for r in runs])
    told = F.explode(F.array(*[F.struct(F.lit(r).alias("min_run"), F.col(f"r{r}").alias("tagged")) for r in runs])).alias("x")
    return counted.select("entries", told).select("x.min_run", "entries", "x.tagged", F.when(F.col("entries") > 0, F.col("x.tagged") / F.col("entries")).otherwise(0.0).alias("fraction"))


def gap_projection(entries: DataFrame, classified: DataFrame, suspect: Column, sampled: Column) -> DataFrame:
    """One row: suspects are unclassified entries that look as if they had a family; the rate among sampled ones that do is projected on all.

    ``(entries, unclassified, suspects, sampled, confirmed, rate, projected)``; ``sampled`` is null
    outside of the sample and else says whether the entry has a family after all.
    """
    rows = entries.join(classified.select("entry_id").distinct().withColumn("known", F.lit(True)), "entry_id", "left")
    open_ = F.col("known").isNull()
    counted = rows.agg(
        F.count("*").alias("entries"), F.count_if(open_).alias("unclassified"), F.count_if(open_ & suspect).alias("suspects"),
        F.count_if(open_ & suspect & sampled.isNotNull()).alias("sampled"), F.count_if(open_ & suspect & sampled).alias("confirmed"),
    )
    rate = F.when(F.col("sampled") > 0, F.col("confirmed") / F.col("sampled")).otherwise(0.0)
    return counted.withColumn("rate", rate).withColumn("projected", F.col("rate") * F.col("suspects"))


def authority_sweep(links: DataFrame, methods: list[str]) -> DataFrame:
    """``(method, covered, components, folded, bridging)``: components by sequences and each authority alone.

    ``links`` is as for :func:`contraction.contracted`, an entry once, with
    families named ``method:family``. ``folded`` is how many components the
    authority's families save, ``bridging`` how many families span several
    components of sequences alone. Entries are read once for all methods: only
    components of parts meet again, and the driver gets counts.
    """
    rows = contracted(links, [f"{m}:" for m in methods])
    entries, held = rows.where("entry_id is not null"), rows.where("family is not null")
    shared = shared_keys(rows)

    def count(labels: DataFrame, node: str) -> int:
        return named(entries.select(node).distinct(), labels, node, "component").agg(F.countDistinct("component")).first()[0]

    alone = labels_across(shared, None, "root_0")
    base = count(alone, "root_0")
    covered = entries.agg(*[F.count_if(f"held_{s}") for s in range(1, len(methods) + 1)]).first()
    spans = spanning(named(held.select("family", "root_0"), alone, "root_0", "component"), "family", "component")
    bridging = spans.agg(*[F.count_if(F.startswith("family", F.lit(f"{m}:"))) for m in methods]).first()
    told = []
    for s, method in enumerate(methods, 1):
        mine = held.where(F.startswith("family", F.lit(f"{method}:"))).select("family", f"root_{s}")
        n = count(labels_across(shared, mine, f"root_{s}"), f"root_{s}")
        told.append((method, covered[s - 1], n, base - n, bridging[s - 1]))
    return rows.sparkSession.createDataFrame(told, "method string, covered long, components long, folded long, bridging long")
