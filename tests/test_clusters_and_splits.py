import hashlib
import random

import pytest
from conftest import rows
from helpers import chain, config, entry, table
from pyspark.sql import functions as F

from partita.config import Fractions
from partita.functions.hashing import bucket
from partita.operators import assign, leakage
from partita.operators.clusters import cluster_entries, merging_families
from partita.operators.graph import connected_components
from partita.operators.prefix import running_before

SEQ = "ACDEFGHIKLMNPQRSTVWY"
EVEN = Fractions(0.8, 0.1, 0.1)


def groups(spark, entries, **cfg):
    found: dict[str, list[str]] = {}
    for r in cluster_entries(table(spark, entries), config(**cfg)).components.collect():
        found.setdefault(r["component"], []).append(r["entry_id"])
    return sorted(sorted(v) for v in found.values())


def one(name, cluster, seq):
    return entry(name, [chain(f"{name}_1", seq, cluster)])


def test_components_of_a_random_graph(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    for small in (10**6, 0):
        got = dict(connected_components(spark.createDataFrame(edges, "src int, dst int"), small=small).collect())
        assert got == {x: root(x) for x in parent}
        assert connected_components(spark.createDataFrame([], "src int, dst int"), small=small).count() == 0
    named = spark.createDataFrame([(f"é{a}", f"b{b}") for a, b in edges], "src string, dst string")
    assert sorted(connected_components(named).collect()) == sorted(connected_components(named, small=0).collect())


def test_bridges_identity_and_gates(spark):
    bridge = entry("C", [chain("C_1", SEQ[:15], 1), chain("C_2", SEQ[5:], 2)])
    a, b = one("A", 1, SEQ + "AA"), one("B", 2, SEQ + "CC")
    assert groups(spark, [a, b]) == [["A"], ["B"]] and groups(spark, [a, b, bridge]) == [["A", "B", "C"]]
    assert groups(spark, [one("A", 1, SEQ * 5), one("B", 2, SEQ * 5)]) == [["A", "B"]]
    partial = lambda n, c, s: entry(n, [chain(f"{n}_1", f"{SEQ}{n}", c), chain(f"{n}_2", s)])
    assert groups(spark, [partial("A", 1, "ACDEF"), partial("B", 2, "ACDEF")]) == [["A"], ["B"]]
    assert groups(spark, [partial("A", 1, "X" * 50), partial("B", 2, "X" * 50)]) == [["A"], ["B"]]
    assert groups(spark, [partial("A", 1, SEQ), partial("B", 2, SEQ)]) == [["A", "B"]]
    assert groups(spark, [one("A", None, "ACD"), one("B", None, "ACD"), one("C", None, "XXX")]) == [["A", "B"], ["C"]]


def test_families_merge_by_authority(spark):
    e = lambda n, c, **f: entry(n, [chain(f"{n}_1", SEQ + n, c, structural=f.get("s"), domains=f.get("d"))])
    entries = [e("A", 1, s={"cath": ["x"]}), e("B", 2, s={"cath": ["x"]}, d={"pfam": ["P"]}), e("C", 3, d={"pfam": ["P"]}), e("D", 4, s={"ecod": ["x"]})]
    assert groups(spark, entries) == [["A"], ["B"], ["C"], ["D"]]
    assert groups(spark, entries, structural_clustering="cath") == [["A", "B"], ["C"], ["D"]]
    assert groups(spark, entries, structural_clustering="pfam") == [["A"], ["B", "C"], ["D"]]
    assert groups(spark, entries, structural_clustering="union") == [["A", "B"], ["C"], ["D"]]
    assert groups(spark, entries, structural_clustering="all") == [["A", "B", "C"], ["D"]]
    c = cluster_entries(table(spark, entries), config(structural_clustering="all"))
    assert merging_families(c.families, c.sequence_components) == 2
    assert c.flags.where("bridging").count() == 0


def test_sequence_groups_are_multisets(spark):
    entries = [entry("A", [chain("1", SEQ, 1), chain("2", "ACD", 2)]), entry("B", [chain("1", "ACD", 3), chain("2", SEQ, 4)]), entry("C", [chain("1", SEQ, 1), chain("2", SEQ, 1)]), entry("D", [chain("1", "XX", 9)])]
    got = dict(cluster_entries(table(spark, entries), config()).sequence_groups.collect())
    assert got["A"] == got["B"] != got["C"] and got["D"] == "D" and got["A"].startswith("seqset:")


def test_buckets_agree_with_the_digest(spark):
    df = spark.createDataFrame([("k",), ("é",)], "component string")
    for name, want in (("md5", lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16) / 2**32), ("blake2b", lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") / 2**64)):
        got = {r[0]: r[1] for r in df.select("component", bucket("s", F.col("component"), name)).collect()}
        assert got == {k: want(f"s:{k}") for k in ("k", "é")}


def components_table(spark, sizes, pins=None):
    df = spark.createDataFrame([(f"c{k:04}", n, (pins or {}).get(k)) for k, n in enumerate(sizes)], "component string, size long, pin string")
    return assign.with_bucket(df, "s")


def totals(sized, assigned):
    out = {"train": 0, "val": 0, "test": 0}
    for r in sized.join(assigned, "component").groupBy("split").agg(F.sum("size").alias("n")).collect():
        out[r["split"]] = r["n"]
    return out


def by_hand(rows_, fractions, strategy):
    """The rules restated as a loop."""
    n = sum(r["size"] for r in rows_)
    order = sorted(rows_, key=lambda r: (r["bucket"], r["component"]))
    got, t = {}, {"val": 0, "test": 0}
    if strategy == "balanced":
        for r in rows_:
            if r["pin"]:
                got[r["component"]] = r["pin"]
                if r["pin"] in t:
                    t[r["pin"]] += r["size"]
            elif r["size"] > 0.002 * n:
                got[r["component"]] = "train"
        for r in order:
            if r["component"] not in got:
                s = next((x for x in ("test", "val") if t[x] < getattr(fractions, x) * n), "train")
                got[r["component"]] = s
                if s in t:
                    t[s] += r["size"]
        return got
    ceiling = (fractions.val + fractions.test) * n
    for r in [x for x in order if x["pin"]] + [x for x in order if not x["pin"]]:
        if r["pin"] == "train":
            s = "train"
        elif sum(t.values()) + r["size"] > ceiling:
            s = "train"
        else:
            s = r["pin"] or ("val" if t["val"] <= t["test"] else "test")
            t[s] += r["size"]
        got[r["component"]] = s
    return got


@pytest.mark.parametrize("seed", range(3))
def test_strategies_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 2, 3, 9]) for _ in range(700)] + [400] * seed
    pins = {rng.randrange(700): rng.choice(["train", "val", "test"]) for _ in range(40 * seed)}
    sized = components_table(spark, sizes, pins)
    listed = [r.asDict() for r in sized.collect()]
    assert dict(assign.assign_balanced(sized, EVEN)[0].collect()) == by_hand(listed, EVEN, "balanced")
    assert dict(assign.assign_maximal(sized, EVEN)[0].collect()) == by_hand(listed, EVEN, "maximal")


def test_worked_cases(spark):
    sized = components_table(spark, [400] + [1] * 200)
    assigned, told = assign.assign_balanced(sized, EVEN)
    assert totals(sized, assigned) == {"train": 480, "val": 60, "test": 60} and told.first().asDict() == {"n_capped": 1, "gap_val": 0, "gap_test": 0}
    thin = components_table(spark, [580] + [1] * 20)
    assert assign.assign_balanced(thin, EVEN)[1].first()["gap_val"] > 0
    tail = components_table(spark, [200] + [1] * 20)
    got = totals(tail, assign.assign_maximal(tail, EVEN)[0])
    assert got["train"] == 200 and abs(got["val"] - got["test"]) <= 1
    assert totals(tail, assign.assign_balanced(components_table(spark, [200] + [1] * 20), EVEN)[0])["val"] == 0
    singles = components_table(spark, [1] * 100)
    assert totals(singles, assign.assign_maximal(singles, EVEN)[0])["train"] >= 80
    giant = components_table(spark, [200] + [1] * 20, {0: "test"})
    assert dict(assign.assign_maximal(giant, EVEN)[0].collect())["c0000"] == "train"


def test_minimums(spark):
    sized = components_table(spark, [300, 5, 2, 2, 1])
    train = sized.select("component", F.lit("train").alias("split"))
    counts = spark.createDataFrame([("c0000", "metal", 100), ("c0001", "metal", 3), ("c0002", "metal", 1), ("c0004", "metal", 1)], "component string, class string, n long")
    got, short = assign.enforce_minimums(train, sized, counts, {"metal": 2}, None)
    assert {r[0] for r in got.where("split = 'test'").collect()} == {"c0004", "c0002"} and short == {}
    got, short = assign.enforce_minimums(train, sized, counts, {"metal": 50}, 0.5)
    assert short == {"metal": 45} and dict(got.collect())["c0000"] == "train"


def test_pins_follow_any_key(spark):
    keys = spark.createDataFrame([("A", "k1"), ("A", "k2"), ("B", "k2"), ("C", "k3")], "entry_id string, raw_key string")
    comps = spark.createDataFrame([("A", "k1"), ("B", "k1"), ("C", "k3")], "entry_id string, component string")
    registry = spark.createDataFrame([("k2", "test"), ("k1", "train"), ("gone", "val")], "raw_key string, split string")
    assert rows(assign.pins(keys, comps, registry)) == [("k1", "test")]
    assigned = spark.createDataFrame([("k1", "test"), ("k3", "val")], "component string, split string")
    assert rows(assign.overridden_pins(assigned, keys, comps, registry)) == [(1, 2)]


def test_running_sums_in_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("n"), (F.pmod(F.xxhash64("id"), F.lit(997)) / 997.0).alias("unit"))
    got = running_before(df, "n", "unit", ["id"], "before", 16).orderBy("unit", "id").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["n"]


def test_leak_checks_catch_a_corrupted_split(spark):
    keys = spark.createDataFrame([("A", "k"), ("B", "k"), ("C", "m")], "entry_id string, raw_key string")
    good = spark.createDataFrame([("A", "train"), ("B", "train"), ("C", "test")], "entry_id string, split string")
    bad = spark.createDataFrame([("A", "train"), ("B", "test"), ("C", "test")], "entry_id string, split string")
    leakage.assert_no_leakage(keys, good)
    with pytest.raises(AssertionError, match="raw_key 'k'"):
        leakage.assert_no_leakage(keys, bad)
    family = spark.createDataFrame([("A", "f"), ("C", "f")], "entry_id string, family string")
    with pytest.raises(AssertionError, match="family 'f'"):
        leakage.assert_no_leakage(keys, good, family)


def test_novelty(spark):
    labels = spark.createDataFrame([("T1", "seen"), ("T2", "new"), ("TR1", "seen"), ("V1", "other")], "entry_id string, family string")
    splits = spark.createDataFrame([("T1", "test"), ("T2", "test"), ("TR1", "train"), ("V1", "val"), ("T3", "test")], "entry_id string, split string")
    assert rows(leakage.novelty(labels, splits).select("entry_id", "novel")) == [("T1", False), ("T2", True), ("TR1", False), ("V1", True)]
    assert leakage.benchmark_summary(labels, splits).first().asDict() == {"n_test": 3, "n_test_classified": 2, "n_test_novel_fold": 1, "n_test_distinct_folds": 2, "n_test_novel_folds": 1}


def test_labels_need_no_components(spark, monkeypatch):
    from partita.operators import clusters

    monkeypatch.setattr(clusters, "components_of", lambda *_: pytest.fail("components for labels"))
    entries = [entry("1ABC", [chain("1ABC_1", structural={"ecod": ["7.1"]})])]
    assert {tuple(r) for r in cluster_entries(table(spark, entries), config(fold_benchmark_method="ecod")).labels.collect()} == {("1ABC", "7.1")}
