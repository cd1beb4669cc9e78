"""Components by parts against union-find, and what is left to join across parts."""

import hashlib
import random

import pytest
from helpers import chain, config, entry, table
from pyspark.sql import functions as F

from partita.operators import audit, clusters, contraction
from partita.operators.clusters import MIN_MERGE_LENGTH, cluster_entries

SEQ = "ACDEFGHIKLMNPQRSTVWY"


def some_entries(n=60, seed=5):
    """Entries of tens that share clusters, sequences and families; some chains are short, unknown or in no cluster."""
    rng, out = random.Random(seed), []
    for k in range(n):
        ten, name, chains = k // 10, f"E{k:03}", []
        for c in range(rng.randrange(4)):
            seq = rng.choice([SEQ + "ACDEFG"[rng.randrange(6)] * (ten + 1), SEQ[:11], "XXXX", "", f"{SEQ}{name}{c}"])
            folds = {"cath": [f"{ten}.{rng.randrange(3)}"]} if rng.random() < 0.3 else {"ecod": [f"{ten % 3}.1"]} if rng.random() < 0.2 else {}
            chains.append(chain(f"{name}_{c}", seq, rng.choice([None, 10 * ten + rng.randrange(4), 1000 + k]), rng.choice(["Protein", "Protein", "DNA"]), structural=folds, domains={"pfam": [f"PF{rng.randrange(30)}"]} if rng.random() < 0.2 else {}))
        out.append(entry(name, chains))
    return out


def by_hand(entries, authorities):
    """Each entry's component, and the keys by entry, restated as loops."""
    proteins = {e["entry_id"]: [c for c in e["polymer_entities"] if c["polymer_type"] == "Protein"] for e in entries}
    least = {}
    for cs in proteins.values():
        for c in cs:
            g = c["cluster_ids"].get("30")
            if g is not None:
                least[g] = min(least.get(g, c["entity_id"]), c["entity_id"])
    parent, first = {}, {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    families = {}
    for name, cs in proteins.items():
        known = [len(c["seq"].replace("X", "")) for c in cs]
        has_cluster, keys = any("30" in c["cluster_ids"] for c in cs), []
        for c, n in zip(cs, known, strict=True):
            content = "singleton:" + hashlib.md5(c["seq"].encode()).hexdigest()
            if "30" in c["cluster_ids"]:
                keys += [least[c["cluster_ids"]["30"]], *([content] if n >= MIN_MERGE_LENGTH else [])]
            elif (n >= MIN_MERGE_LENGTH) if has_cluster else (n > 0 or not any(known)):
                keys.append(content)
        if keys:
            first[name] = keys[0]
            for k in keys:
                join(k, keys[0])
            for c in cs:
                for a, fs in (c["structural_families"] | c["domain_families"]).items():
                    families.setdefault(a, []).extend((name, f) for f in fs)
    for a in authorities:
        held = {}
        for name, f in families.get(a, []):
            join(first[name], first[held.setdefault(f, name)])
    return {name: root(k) for name, k in first.items()}, families


@pytest.fixture(params=[1, 7, 10**6], ids=["blocks of an entry", "small blocks", "one block"])
def blocks(request, monkeypatch):
    monkeypatch.setattr(contraction, "BLOCK_ROWS", request.param)


def test_components_by_parts(spark, blocks, monkeypatch):
    monkeypatch.setattr(clusters, "connected_components", lambda *_: pytest.fail("rounds over all keys"))
    for authorities in ("off", "all"):
        cfg = config(structural_clustering=authorities, hash_name="md5")
        entries = some_entries()
        found = cluster_entries(table(spark, entries).repartition(5, F.rand(1)), cfg).both_components.collect()
        assert len(found) == len({r["entry_id"] for r in found})
        assert {r["entry_id"]: r["sequence_component"] for r in found} == by_hand(entries, ())[0]
        assert {r["entry_id"]: r["component"] for r in found} == by_hand(entries, cfg.merge_authorities)[0]


def test_an_entry_read_twice_counts_once(spark):
    entries = some_entries(20)
    found = cluster_entries(table(spark, entries + entries), config(structural_clustering="all", hash_name="md5"))
    assert {r["entry_id"]: r["component"] for r in found.components.collect()} == by_hand(entries, ("cath", "ecod", "pfam"))[0]
    assert found.components.count() == len(by_hand(entries, ())[0])


def test_what_lies_together_leaves_no_edges(spark, monkeypatch):
    seen = []
    real = contraction.connected_components
    monkeypatch.setattr(contraction, "connected_components", lambda edges, *a: (seen.append(edges.count()), real(edges, *a))[1])
    entries = [entry(f"E{k:02}", [chain(f"E{k:02}_1", f"{SEQ}{k}", k // 10)]) for k in range(40)]
    whole = table(spark, entries).coalesce(1)
    assert cluster_entries(whole, config()).components.select("component").distinct().count() == 4 and seen == [0]


def test_sweep_by_parts(spark, blocks):
    entries, cfg, methods = some_entries(), config(structural_clustering="all"), ["cath", "ecod", "pfam"]
    alone, families = by_hand(entries, ())
    want = []
    for m in methods:
        merged, spans = by_hand(entries, (m,))[0], {}
        for name, f in families[m]:
            spans.setdefault(f, set()).add(alone[name])
        n, base = len(set(merged.values())), len(set(alone.values()))
        want.append((m, len({name for name, _ in families[m]}), n, base - n, sum(len(x) > 1 for x in spans.values())))
    links = clusters.links(clusters.chains(table(spark, entries).repartition(3, "entry_id"), cfg), cfg.merge_authorities)
    assert sorted(tuple(r) for r in audit.authority_sweep(links, methods).collect()) == want
