"""Keys of entries and the components they form.

An entry holds *keys*: the cluster of each of its chains, and the content of
chains that no cluster covers. Entries that share a key, and keys that share a
family of an authority, belong to one component; a component is named by its
smallest key. Edges run from each entry's smallest key to its others, never
between pairs of entries.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.config import STRUCTURAL, Config
from partita.functions.hashing import content_key
from partita.functions.text import modeled_length
from partita.operators import contraction
from partita.operators.filters import is_protein
from partita.operators.graph import connected_components

#: Known residues that a chain outside of all clusters needs to merge an entry that has clusters.
MIN_MERGE_LENGTH = 12
#: Before the content of a chain.
SINGLETON = "singleton:"


def chains(entries: DataFrame, cfg: Config) -> DataFrame:
    """A row for each protein chain: entry, chain, its cluster at the level, its content key and known length.

    ``entries`` has a row for each entry; ``has_cluster`` and ``has_known`` say
    whether any of its chains has a cluster, and known residues.
    """
    level = F.lit(str(cfg.identity_level))
    has_cluster = F.exists("proteins", lambda e: F.try_element_at(e["cluster_ids"], level).isNotNull())
    has_known = F.exists("proteins", lambda e: modeled_length(F.coalesce(e["seq"], F.lit("")), both_cases=False) > 0)
    rows = entries.select("entry_id", F.filter("polymer_entities", is_protein).alias("proteins"))
    rows = rows.select("entry_id", F.coalesce(has_cluster, F.lit(False)).alias("has_cluster"), F.coalesce(has_known, F.lit(False)).alias("has_known"), F.explode("proteins").alias("e"))
    seq = F.coalesce(F.col("e.seq"), F.lit(""))
    return rows.select(
        "entry_id", F.col("e.entity_id").alias("chain"), "has_cluster", "has_known", F.try_element_at("e.cluster_ids", level).alias("cluster_id"),
        content_key(SINGLETON, seq, cfg.hash_name).alias("content"), modeled_length(seq, both_cases=False).alias("known"), seq.alias("seq"),
        F.col("e.structural_families").alias("structural"), F.col("e.domain_families").alias("domains"),
    )


def chain_keys(chain: DataFrame) -> DataFrame:
    """The chains with ``raw_key`` (their cluster's smallest chain) and ``bridge``, the key by which they join their entry, if any.

    Chains outside of clusters always key an entry that has nothing else: by
    those with known residues, or by all of them if none has any.
    """
    least = chain.where("cluster_id is not null").groupBy("cluster_id").agg(F.min("chain").alias("raw_key"))
    out = chain.join(least, "cluster_id", "left")
    return out.withColumn("bridge", F.when(F.col("raw_key").isNotNull(), F.col("raw_key")).when(_loose(), F.col("content")))


def _loose() -> Column:
    """Whether the content of a chain outside of all clusters keys its entry."""
    return F.when(F.col("has_cluster"), F.col("known") >= MIN_MERGE_LENGTH).otherwise((F.col("known") > 0) | ~F.col("has_known"))


def links(chain: DataFrame, authorities: tuple[str, ...]) -> DataFrame:
    """``(entry_id, key, name, family)`` for :func:`contraction.contracted`: the chains' clusters and contents as keys, and their families.

    A cluster counts by the names of its chains: the smallest name in a
    component is its smallest key, as all chains of a cluster are in one.
    """
    clustered = F.col("cluster_id").isNotNull() & F.col("chain").isNotNull()
    cluster = F.when(clustered, F.encode(F.concat(F.lit("c"), F.col("cluster_id").cast("string")), "utf-8"))
    content = F.when(F.when(clustered, F.col("known") >= MIN_MERGE_LENGTH).otherwise(_loose()), F.unhex(F.substring("content", len(SINGLETON) + 1, 64)))
    no = F.lit(None)
    row = lambda key, name, family: F.struct(key.cast("binary").alias("key"), name.cast("string").alias("name"), family.cast("string").alias("family"))
    keys = F.array(row(cluster, F.col("chain"), no), row(content, F.col("content"), no))
    told = F.concat(keys, F.transform(families(F.col("structural"), F.col("domains"), authorities), lambda f: row(no, no, f))) if authorities else keys
    return chain.select("entry_id", F.inline(told)).where("key is not null or family is not null")


def entry_keys(keyed: DataFrame) -> DataFrame:
    """Distinct ``(entry_id, raw_key)``, exact content of long clustered chains included."""
    identity = F.when(F.col("raw_key").isNotNull() & (F.col("known") >= MIN_MERGE_LENGTH), F.col("content"))
    rows = keyed.select("entry_id", F.explode(F.array_compact(F.array("bridge", identity))).alias("raw_key"))
    return rows.distinct()


def entry_flags(keyed: DataFrame) -> DataFrame:
    """``entry_id, bridging, unclustered``: joins several keys (identity apart); has no clustered chain."""
    return keyed.groupBy("entry_id").agg((F.countDistinct("bridge") > 1).alias("bridging"), (~F.bool_or("has_cluster")).alias("unclustered"))


def families(structural: Column, domains: Column, authorities: tuple[str, ...]) -> Column:
    """Families of the authorities; several authorities are told apart by a prefix."""
    none = F.array().cast("array<string>")

    def of(a: str) -> Column:
        held = F.coalesce(F.try_element_at(structural if a in STRUCTURAL else domains, F.lit(a)), none)
        return F.transform(held, lambda f: F.concat(F.lit(f"{a}:"), f)) if len(authorities) > 1 else held

    parts = [of(a) for a in authorities]
    return F.array_distinct(F.concat(*parts)) if parts else none


def family_keys(keyed: DataFrame, keys: DataFrame, authorities: tuple[str, ...]) -> DataFrame:
    """Distinct ``(entry_id, family, raw_key)``: the key of the chain that has the family, else its entry's smallest key."""
    rows = keyed.select("entry_id", "bridge", F.explode(families(F.col("structural"), F.col("domains"), authorities)).alias("family"))
    least = keys.groupBy("entry_id").agg(F.min("raw_key").alias("least"))
    return rows.join(least, "entry_id").select("entry_id", "family", F.coalesce("bridge", "least").alias("raw_key")).distinct()


def star_edges(rows: DataFrame, group: str, node: str) -> DataFrame:
    """From the smallest node of each group to all of its nodes: as many edges as rows."""
    least = rows.groupBy(group).agg(F.min(node).alias("src"))
    return rows.join(least, group).select("src", F.col(node).alias("dst")).distinct()


def components_of(keys: DataFrame, family_rows: DataFrame | None = None, entry: str = "entry_id", key: str = "raw_key") -> DataFrame:
    """``(entry, component)``: the smallest key that can be reached over shared entries and families."""
    edges = star_edges(keys, entry, key)
    if family_rows is not None:
        edges = edges.unionByName(star_edges(family_rows, "family", key))
    labels = connected_components(edges)
    least = keys.groupBy(entry).agg(F.min(key).alias("node"))
    return least.join(labels, "node").select(entry, "component")


def sequence_groups(entries: DataFrame, cfg: Config) -> DataFrame:
    """``(entry_id, sequence_group)``: equal for entries whose chains with known residues are the same multiset."""
    rows = chains(entries, cfg).where("known > 0")
    joined = F.array_join(F.sort_array(F.collect_list("seq")), "\0")
    grouped = rows.groupBy("entry_id").agg(joined.alias("joined"))
    grouped = grouped.select("entry_id", content_key("seqset:", F.col("joined"), cfg.hash_name).alias("group"))
    return entries.select("entry_id").join(grouped, "entry_id", "left").select("entry_id", F.coalesce("group", "entry_id").alias("sequence_group"))


def bridging_families(family_rows: DataFrame, sequence_components: DataFrame) -> DataFrame:
    """``(family, n_components)`` of the families that span several components of sequences alone."""
    spans = family_rows.join(sequence_components, "entry_id").groupBy("family").agg(F.countDistinct("component").alias("n_components"))
    return spans.where("n_components > 1")


def merging_families(family_rows: DataFrame, sequence_components: DataFrame) -> int:
    """How many families join components when families are merged one by one in order.

    The count depends on the order, so it is a sequential fold; it sees only
    the families that span several components, streamed in order.
    """
    spanning = bridging_families(family_rows, sequence_components)
    rows = family_rows.join(sequence_components, "entry_id").join(spanning, "family", "left_semi").select("family", "component").distinct()
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    count, family, first, joined = 0, None, "", False
    for row in rows.orderBy("family", "component").toLocalIterator():
        if row["family"] != family:
            count += joined
            family, first, joined = row["family"], row["component"], False
            continue
        a, b = root(first), root(row["component"])
        if a != b:
            parent[max(a, b)] = min(a, b)
            joined = True
    return count + joined


@dataclass(frozen=True)
class Clustering:
    """Narrow tables of one clustering; each is planned, and its components are computed, when it is first asked for."""

    entries: DataFrame
    cfg: Config

    @cached_property
    def keyed(self) -> DataFrame:
        return chain_keys(chains(self.entries, self.cfg))

    @cached_property
    def keys(self) -> DataFrame:
        return entry_keys(self.keyed)

    @cached_property
    def both_components(self) -> DataFrame:
        """``(entry_id, component, sequence_component)``; the second one by keys alone."""
        merged = self.cfg.merge_authorities
        rows = contraction.contracted(links(chains(self.entries, self.cfg), merged), [""] if merged else [])
        shared = contraction.shared_keys(rows)
        out = contraction.named(rows.where("entry_id is not null"), contraction.labels_across(shared, None, "root_0"), "root_0", "sequence_component")
        if merged:
            by_family = rows.where("family is not null").select("family", "root_1")
            out = contraction.named(out, contraction.labels_across(shared, by_family, "root_1"), "root_1", "component")
        else:
            out = out.withColumn("component", F.col("sequence_component"))
        return out.select("entry_id", "component", "sequence_component").distinct()

    @cached_property
    def components(self) -> DataFrame:
        return self.both_components.select("entry_id", "component")

    @cached_property
    def flags(self) -> DataFrame:
        return entry_flags(self.keyed)

    @cached_property
    def sequence_groups(self) -> DataFrame:
        return sequence_groups(self.entries, self.cfg)

    @cached_property
    def families(self) -> DataFrame | None:
        return family_keys(self.keyed, self.keys, self.cfg.merge_authorities) if self.cfg.merge_authorities else None

    @cached_property
    def labels(self) -> DataFrame | None:
        if self.cfg.fold_benchmark_method == "off":
            return None
        named = families(F.col("structural"), F.col("domains"), (self.cfg.fold_benchmark_method,))
        return chains(self.entries, self.cfg).select("entry_id", F.explode(named).alias("family")).distinct()

    @cached_property
    def sequence_components(self) -> DataFrame:
        return self.both_components.select("entry_id", F.col("sequence_component").alias("component"))


def cluster_entries(entries: DataFrame, cfg: Config) -> Clustering:
    return Clustering(entries, cfg)
