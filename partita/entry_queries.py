"""The entry operators (filters, tiers, keys, clusters, builds, views, parsing) on an entry table, with their SQL.

The entry table is made of the star schema: an order is an entry, its numbered
lines are its chains, and the parts of its lines name its components. Chains
share clusters, sequences and families with the other orders of their ten, so
that components stay small enough for SQL; what a very large component costs is
measured by ``order_components_all``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.config import Config, Fractions
from partita.functions import text as tx
from partita.operators import assign, audit, clusters, filters, leakage, tiers
from partita.plans import build as plans
from partita.plans.loader import View
from partita.sources import entries as source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CFG = Config(
    snapshot_date="1999-06-30", experimental_methods=("X-RAY DIFFRACTION", "ELECTRON MICROSCOPY"), resolution_max_A=3.0, resolution_max_A_by_method={"ELECTRON MICROSCOPY": 4.0},
    max_total_residues=5000, identity_threshold=0.3, split_fractions=Fractions(0.8, 0.1, 0.1), split_salt="entries", min_modeled_residues=20, max_clashscore=45.0, max_rfree=0.36,
    max_ramachandran_outlier_pct=0.7, min_em_backbone_inclusion=0.2, excluded_het=("FAD",), fold_benchmark_method="ecod", structural_clustering="all", split_strategy="hash", hash_name="md5",
)

# What the component of a line is, by the part's number modulo 20: identifier, formula, type, whether its site is a metal's and it is an ion.
COMPONENTS = [
    ("ZN", "Zn 2+", "non-polymer", True, True), ("NA", "Na 1+", "non-polymer", True, True), ("HG", "Hg 2+", "non-polymer", True, True), ("NI", "Ni 2+", "non-polymer", True, True),
    ("GOL", "C3 H8 O3", "non-polymer", False, False), ("NAG", "C8 H15 N O6", "D-saccharide, beta linking", False, False), ("ATP", "C10 H16 N5 O13 P3", "non-polymer", False, False),
    ("HEM", "C34 H32 Fe N4 O4", "NON-POLYMER", False, False), ("SF4", "Fe4 S4", "non-polymer", True, False), ("CO", "Co 2+", "non-polymer", True, True), ("IOD", "I 1-", None, False, False),
    ("SO4", "O4 S 2-", "non-polymer", False, False), ("FES", "Fe2 S2", "non-polymer", True, False), ("FAD", "C27 H33 N9 O15 P2", "non-polymer", False, False), ("CL", "Cl 1-", "non-polymer", False, False),
    ("MG", None, "non-polymer", True, True), ("XYZ", None, "L-Saccharide", False, False),
]


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH RECURSIVE {sql}"
        return f

    return add


# --- the entry table ----------------------------------------------------------------------------


def chain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln")).agg(F.min("l_partkey").alias("pk")).withColumn("d", F.floor(F.col("o") / 10))


def sequence() -> Column:
    """32 letters or a multiple, shared in a ten of orders; some tagged, some unknown, some missing."""
    letters = F.translate(F.md5(F.concat_ws(":", "d", F.col("pk") % 6)), "0123456789abcdef", "ACDEFGHIKLMNPQXH")
    kind = F.col("pk") % 11
    return F.when(kind == 0, F.concat(F.lit("HHHHHH"), letters)).when(kind == 1, F.lit("X" * 10)).when(kind == 2, F.lit("")).when(kind == 3, F.concat(letters, F.lit("xxhh"))).when(kind == 4, F.substring(letters, 1, 11)).otherwise(letters)


def _family(kind: Column, pairs: list[tuple[int, str, Column]]) -> Column:
    """A map of the one authority that ``kind`` names, or an empty one."""
    out = F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>")
    for k, name, value in pairs:
        out = F.when(kind == k, F.create_map(F.lit(name), F.array(value))).otherwise(out)
    return out


def polymer() -> Column:
    """The polymer entity of a chain ``(o, ln, pk, d)``."""
    pk, d = F.col("pk"), F.col("d").cast("string")
    kind = F.when(pk % 9 == 0, "DNA").when(pk % 9 == 1, "RNA").when(pk % 9 == 2, "NA-hybrid").when(pk % 9 == 3, "Other").otherwise("Protein (L)")
    levels = F.create_map(F.lit("90"), (pk % 1000).cast("int"), F.lit("30"), (F.col("d") * 10 + pk % 4).cast("int"))
    return F.struct(
        F.concat_ws("_", "o", "ln").alias("entity_id"), kind.alias("polymer_type"), F.length(sequence()).cast("int").alias("seq_len"), sequence().alias("seq"),
        F.when(pk % 5 != 0, levels).otherwise(F.map_from_arrays(F.array(), F.array()).cast("map<string,int>")).alias("cluster_ids"),
        F.when(pk % 13 == 0, F.array(F.lit("ZN"))).when(pk % 13 == 1, F.array(F.lit("METAL"), F.lit("NI"))).otherwise(F.array().cast("array<string>")).alias("metal_annotations"),
        _family(pk % 4, [(0, "cath", F.concat_ws(".", d, pk % 3)), (1, "ecod", F.concat_ws(".", (F.col("d") % 40).cast("string"), pk % 2))]).alias("structural_families"),
        _family(pk % 6, [(0, "pfam", F.concat(F.lit("PF"), d, (pk % 2).cast("string")))]).alias("domain_families"),
    )


def polymer_table(chains: DataFrame) -> DataFrame:
    """``polymer_entities`` of each order, from its chains."""
    return chains.groupBy("o").agg(F.array_sort(F.collect_list(polymer().alias("p")), lambda a, b: F.when(a["entity_id"] < b["entity_id"], -1).when(a["entity_id"] > b["entity_id"], 1).otherwise(0)).alias("polymer_entities"))


def chain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entry_id`` and ``polymer_entities`` (in no order) of all orders: what clustering reads of an entry.

    Orders and lines are dealt once, by tens of orders, which share clusters and sequences.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.lit(False).alias("order"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("o"), F.lit(None).cast("int").alias("ln"), F.lit(None).cast("long").alias("pk"), F.lit(True).alias("order"))
    ten = F.floor(F.col("o") / 10)
    dealt = lines.unionByName(orders).where("o is not null").repartition(ten).withColumn("d", ten)
    dealt = dealt.groupBy("d", "o", "ln", "order").agg(F.min("pk").alias("pk"))
    found = dealt.groupBy("d", "o").agg(F.collect_list(F.when(~F.col("order"), polymer())).alias("polymer_entities"), F.bool_or("order").alias("order"))
    return found.where("order").select(F.col("o").cast("string").alias("entry_id"), "polymer_entities")


def entry_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ENTRY_SCHEMA`` rows of all orders."""
    polymers = polymer_table(chain_lines(spark, sf_dir))
    known = F.broadcast(spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(COMPONENTS)], "k long, comp_id string, formula string, comp_type string"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("k", F.col("l_partkey") % 20).join(known, "k")
    comps = lines.groupBy(F.col("l_orderkey").alias("o"), "comp_id", "formula", "comp_type").agg(F.bool_or(F.col("l_returnflag") == "R").alias("bound"), F.bool_or(F.col("l_quantity") >= 45).alias("affinity"), F.bool_or(F.col("l_tax") >= 0.08).alias("investigated"))
    having = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("comp_id"))))
    comps = comps.groupBy("o").agg(
        F.array_sort(F.collect_list(F.struct("comp_id", F.lit("").alias("name"), "formula", "comp_type"))).alias("nonpolymer_comps"),
        having("bound").alias("bound_components"), having("affinity").alias("affinity_comp_ids"), having("investigated").alias("investigated_comp_ids"),
    )
    o = F.col("o_orderkey")
    methods = F.when(o % 5 == 0, F.array(F.lit("X-RAY DIFFRACTION"))).when(o % 5 == 1, F.array(F.lit("ELECTRON MICROSCOPY"))).when(o % 5 == 2, F.array(F.lit("SOLUTION NMR"))).when(o % 5 == 3, F.array(F.lit("ELECTRON MICROSCOPY"), F.lit("X-RAY DIFFRACTION"))).otherwise(F.array().cast("array<string>"))
    sizes = F.when(o % 3 == 1, F.create_map(F.lit("A-2"), F.lit(1), F.lit("A-1"), (o % 6000).cast("int"))).when(o % 3 == 2, F.create_map(F.lit("B-3"), (o % 7000).cast("int"))).otherwise(F.map_from_arrays(F.array(), F.array()).cast("map<string,int>"))
    em = o % 5 == 1
    quality = F.struct(
        F.when(o % 6 != 0, (o % 50).cast("double")).alias("clashscore"), F.when(~em, (o % 9) / 10.0).alias("ramachandran_outlier_pct"), F.lit(None).cast("double").alias("rotamer_outlier_pct"),
        F.when(~em, (o % 40) / 100.0).alias("rfree"), F.lit(None).cast("double").alias("rsrz_outlier_pct"), F.when(em, (o % 10) / 10.0).alias("em_backbone_inclusion"),
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        o.alias("o"), o.cast("string").alias("entry_id"), methods.alias("methods"), F.when(o % 11 != 0, F.col("o_totalprice") / 100000).alias("resolution_A"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"), F.when(o % 17 != 0, (o * 37 % 6000).cast("int")).alias("deposited_residues"), sizes.alias("assemblies"),
        F.when(o % 4 != 3, (o % 4).cast("int")).alias("protein_na_interface_count"), quality.alias("quality"),
    )
    joined = orders.join(polymers, "o", "left").join(comps, "o", "left")
    empty = {f.name: f.dataType for f in joined.schema if f.name in ("polymer_entities", "nonpolymer_comps", "bound_components", "affinity_comp_ids", "investigated_comp_ids")}
    filled = joined.select(*[F.coalesce(c, F.array().cast(empty[c])).alias(c) if c in empty else F.col(c) for c in joined.columns if c != "o"])
    order = ("entry_id", "methods", "resolution_A", "release_date", "deposited_residues", "assemblies", "polymer_entities", "nonpolymer_comps", "bound_components", "affinity_comp_ids", "investigated_comp_ids", "protein_na_interface_count", "quality")
    return filled.select(*order)


_SEQ = """CASE pk % 11 WHEN 0 THEN 'HHHHHH' || s WHEN 1 THEN repeat('X', 10) WHEN 2 THEN '' WHEN 3 THEN s || 'xxhh' WHEN 4 THEN substr(s, 1, 11) ELSE s END"""
#: Chains (pe), components (np) and orders (en) as flat tables.
_FLAT = f"""
  l1 AS (SELECT l_orderkey AS o, l_linenumber AS ln, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2),
  l2 AS (SELECT *, o // 10 AS d, translate(md5((o // 10) || ':' || (pk % 6)), '0123456789abcdef', 'ACDEFGHIKLMNPQXH') AS s FROM l1),
  pe AS (SELECT o::VARCHAR AS entry_id, o, d, pk, o || '_' || ln AS entity_id, {_SEQ} AS seq, pk % 9 >= 4 AS protein, pk % 9 < 3 AS nucleic, CASE WHEN pk % 5 <> 0 THEN d * 10 + pk % 4 END AS cluster,
    CASE pk % 13 WHEN 0 THEN ['ZN'] WHEN 1 THEN ['METAL', 'NI'] ELSE [] END AS annotations FROM l2),
  ck(k, comp_id, comp_type, metal, ion) AS (VALUES {', '.join(f"({k}, '{c[0]}', '{c[2] or ''}', {c[3]}, {c[4]})" for k, c in enumerate(COMPONENTS))}),
  np AS (SELECT l_orderkey::VARCHAR AS entry_id, comp_id, comp_type, metal, ion, bool_or(l_returnflag = 'R') AS bound, bool_or(l_quantity >= 45) AS affinity, bool_or(l_tax >= 0.08) AS investigated
    FROM lineitem JOIN ck ON k = l_partkey % 20 GROUP BY ALL),
  en AS (SELECT o_orderkey AS o, o_orderkey::VARCHAR AS entry_id, o_orderkey % 5 AS m, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 100000 END AS res, strftime(o_orderdate, '%Y-%m-%d') AS released,
    CASE o_orderkey % 3 WHEN 1 THEN o_orderkey % 6000 WHEN 2 THEN o_orderkey % 7000 ELSE CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey * 37 % 6000 END END AS residues,
    coalesce(CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 4 END, 0) AS contacts FROM orders)"""
_FILTER = f"""{_FLAT},
  pr AS (SELECT entry_id, max(length(regexp_replace(seq, '[Xx]', '', 'g'))) AS best FROM pe WHERE protein GROUP BY 1),
  fj AS (SELECT en.*, pr.best, CASE m WHEN 0 THEN 3.0 WHEN 1 THEN 4.0 WHEN 3 THEN 4.0 ELSE 3.0 END AS cap, CASE WHEN o % 6 <> 0 THEN o % 50 END AS clash, CASE WHEN m <> 1 THEN (o % 40) / 100.0::DOUBLE END AS rfree,
    CASE WHEN m <> 1 THEN (o % 9) / 10.0::DOUBLE END AS rama, CASE WHEN m = 1 THEN (o % 10) / 10.0::DOUBLE END AS inclusion FROM en LEFT JOIN pr USING (entry_id)),
  fr AS (SELECT *, CASE WHEN best IS NULL THEN 'no_protein_entity' WHEN best = 0 THEN 'no_protein_sequence' WHEN best < 20 THEN 'sequence_too_short' WHEN residues > 5000 THEN 'too_large' WHEN res > cap THEN 'resolution_too_low'
    WHEN clash > 45 THEN 'clashscore_too_high' WHEN rfree > 0.36::DOUBLE THEN 'rfree_too_high' WHEN rama > 0.7::DOUBLE THEN 'ramachandran_outliers_too_high' WHEN inclusion < 0.2::DOUBLE THEN 'em_backbone_inclusion_too_low' END AS drop_reason FROM fj),
  fd AS (SELECT entry_id, drop_reason, CASE drop_reason WHEN 'sequence_too_short' THEN best WHEN 'too_large' THEN residues WHEN 'resolution_too_low' THEN res WHEN 'clashscore_too_high' THEN clash WHEN 'rfree_too_high' THEN rfree
    WHEN 'ramachandran_outliers_too_high' THEN rama WHEN 'em_backbone_inclusion_too_low' THEN inclusion END::DOUBLE AS drop_value FROM fr),
  kp AS (SELECT entry_id FROM fd WHERE drop_reason IS NULL)"""


@query(f"{_FILTER} SELECT * FROM fd")
def entry_filter(spark, sf_dir):
    return filters.with_drop_reason(entry_table(spark, sf_dir), filters.entry_rules(CFG)).select("entry_id", "drop_reason", "drop_value")


@query(f"{_FILTER} SELECT drop_reason AS reason, count(*) AS n FROM fd WHERE drop_reason IS NOT NULL GROUP BY 1")
def entry_drops(spark, sf_dir):
    return filters.drop_histogram(filters.filter_entries(entry_table(spark, sf_dir), CFG)[1])


@query(f"{_FLAT} SELECT entry_id, (o % 6 <> 0 OR m IN (0, 1, 2, 3, 4)) AS has_report FROM en")
def entry_reports(spark, sf_dir):
    return entry_table(spark, sf_dir).select("entry_id", filters.has_report(F.col("quality")).alias("has_report"))


_SCAN = "m IN (0, 1, 3) AND (res IS NULL OR res <= 4.0) AND released <= '1999-06-30'"


@query(f"{_FLAT} SELECT entry_id, released AS release_date FROM en WHERE {_SCAN} ORDER BY entry_id LIMIT 400")
def entry_scan(spark, sf_dir):
    return source.scan(entry_table(spark, sf_dir), CFG, limit=400).select("entry_id", "release_date")


@query(f"{_FLAT} SELECT count(*) AS n FROM en WHERE {_SCAN}")
def entry_count(spark, sf_dir):
    return spark.createDataFrame([(source.count_entries(entry_table(spark, sf_dir), CFG),)], "n long")


# --- tiers --------------------------------------------------------------------------------------

_RUN = "coalesce(list_max(list_transform(regexp_extract_all(upper({0}), 'H+'), lambda x: length(x))), 0)"
_TIERS = f"""{_FLAT},
  tg AS (SELECT entry_id, bool_or(protein AND ({_RUN.format("seq")} >= 6 OR greatest({_RUN.format("substr(seq, 1, 20)")}, {_RUN.format("right(seq, 20)")}) >= 3)) AS tag, bool_or(nucleic) AS nucleic,
    list_distinct(flatten(list(CASE WHEN protein THEN annotations END) FILTER (WHERE protein))) AS annotated FROM pe GROUP BY 1),
  io AS (SELECT entry_id, bool_and(comp_id IN ('NI', 'CO')) AS pure FROM np WHERE ion GROUP BY 1),
  ef AS (SELECT en.entry_id, coalesce(pure, false) AND coalesce(tag, false) AS artifact, coalesce(pure, false) AND NOT coalesce(tag, false) AS lone, coalesce(nucleic, false) AS nucleic, contacts > 0 AS interface, coalesce(annotated, []) AS annotated
    FROM en LEFT JOIN tg USING (entry_id) LEFT JOIN io USING (entry_id)),
  t0 AS (SELECT np.*, ef.*, list_contains(annotated, comp_id) AS said, comp_id IN ('NI', 'CO') AS pur, contains(lower(comp_type), 'saccharide') AS sugar FROM np JOIN ef USING (entry_id)),
  t1 AS (SELECT entry_id, comp_id, metal, artifact AS purification_artifact, CASE WHEN comp_id IN ('NA', 'CL', 'IOD') THEN 'counterion' WHEN metal AND affinity THEN 'metal_affinity' WHEN metal AND said THEN 'metal_annotated'
    WHEN metal AND investigated THEN 'metal_investigated' WHEN metal AND comp_id = 'HG' THEN 'phasing_metal' WHEN metal AND artifact AND pur THEN 'histag_metal'
    WHEN metal AND lone AND pur AND len(annotated) > 0 THEN 'metal_site_nonnative' WHEN metal AND lone AND pur THEN 'purification_metal_uncorroborated' WHEN metal AND bound THEN 'metal_bound' WHEN metal THEN 'metal_unbound'
    WHEN affinity THEN 'ligand_affinity' WHEN sugar THEN 'glycan' WHEN investigated THEN 'ligand_investigated' WHEN comp_id IN ('GOL', 'SO4', 'FAD') THEN 'additive' WHEN bound THEN 'ligand_bound' ELSE 'ligand_unbound' END AS reason FROM t0),
  t2 AS (SELECT entry_id, comp_id, reason, purification_artifact, CASE WHEN metal THEN 'metal' ELSE 'small_molecule' END AS would_be,
    CASE WHEN reason IN ('counterion', 'histag_metal', 'additive') THEN 'artifact' WHEN reason IN ('phasing_metal', 'metal_site_nonnative', 'purification_metal_uncorroborated', 'metal_unbound', 'glycan', 'ligand_unbound') THEN 'ambiguous' ELSE 'functional' END AS tier FROM t1
    UNION ALL SELECT entry_id, 'nucleic_acid', CASE WHEN interface THEN 'protein_na_interface' ELSE 'no_protein_na_interface' END, artifact, 'nucleic_acid', CASE WHEN interface THEN 'functional' ELSE 'ambiguous' END FROM ef WHERE nucleic),
  ti AS (SELECT entry_id, comp_id, tier, reason, CASE WHEN tier = 'functional' THEN would_be END AS class, would_be, purification_artifact FROM t2),
  ec AS (SELECT entry_id, list_sort(list_distinct(list(class) FILTER (WHERE class IS NOT NULL))) AS cs, list_sort(list_distinct(list(would_be) FILTER (WHERE tier = 'ambiguous'))) AS maybe,
    coalesce(string_agg(DISTINCT comp_id, ',' ORDER BY comp_id) FILTER (WHERE class = 'metal'), '') AS metals, coalesce(string_agg(DISTINCT comp_id, ',' ORDER BY comp_id) FILTER (WHERE class = 'small_molecule'), '') AS small_molecules,
    bool_or(would_be = 'nucleic_acid') AS has_nucleic_acid, bool_or(purification_artifact) AS purification_artifact, string_agg(comp_id || '=' || tier || ':' || reason, ',' ORDER BY comp_id) AS tiers FROM ti GROUP BY 1),
  ea AS (SELECT *, coalesce(cs, []) AS classes_, list_filter(coalesce(maybe, []), lambda x: NOT list_contains(coalesce(cs, []), x)) AS ambiguous_ FROM ec)"""


@query(f"{_TIERS} SELECT entry_id, comp_id, tier, reason, class, would_be, purification_artifact FROM ti")
def entry_component_tiers(spark, sf_dir):
    return tiers.component_tiers(entry_table(spark, sf_dir), CFG)


@query(f"{_TIERS} SELECT entry_id, array_to_string(classes_, ',') AS classes, array_to_string(ambiguous_, ',') AS ambiguous_classes, metals, small_molecules, has_nucleic_acid, purification_artifact, tiers FROM ea")
def entry_class_table(spark, sf_dir):
    found = tiers.entry_classes(tiers.component_tiers(entry_table(spark, sf_dir), CFG))
    told = F.transform(F.map_entries("tiers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["tier"], F.lit(":"), e["value"]["reason"]))
    joined = [F.array_join(c, ",").alias(c) for c in ("classes", "ambiguous_classes", "metals", "small_molecules")]
    return found.select("entry_id", *joined, "has_nucleic_acid", "purification_artifact", F.array_join(told, ",").alias("tiers"))


@query(f"{_TIERS} SELECT tier || ':' || reason AS tier_reason, count(*) AS n FROM ti GROUP BY 1")
def entry_tier_reasons(spark, sf_dir):
    return tiers.tier_histogram(tiers.component_tiers(entry_table(spark, sf_dir), CFG))


# --- keys, components, groups -------------------------------------------------------------------


def _clustering_sql(entries: str) -> str:
    """Keys, components (of sequences alone, and merged by families), flags, groups and labels of the entries of a table."""
    return f"""
  ch AS (SELECT *, length(replace(seq, 'X', '')) AS known, 'singleton:' || md5(seq) AS content FROM pe WHERE protein AND entry_id IN (SELECT entry_id FROM {entries})),
  cm AS (SELECT cluster, min(entity_id) AS least FROM ch WHERE cluster IS NOT NULL GROUP BY 1),
  c2 AS (SELECT ch.*, least AS raw, bool_or(ch.cluster IS NOT NULL) OVER (PARTITION BY entry_id) AS has_cluster, bool_or(known > 0) OVER (PARTITION BY entry_id) AS has_known FROM ch LEFT JOIN cm USING (cluster)),
  c3 AS (SELECT *, coalesce(raw, CASE WHEN CASE WHEN has_cluster THEN known >= 12 ELSE known > 0 OR NOT has_known END THEN content END) AS bridge FROM c2),
  ek AS (SELECT entry_id, bridge AS raw_key FROM c3 WHERE bridge IS NOT NULL UNION SELECT entry_id, content FROM c3 WHERE raw IS NOT NULL AND known >= 12),
  lk AS (SELECT entry_id, min(raw_key) AS least_key FROM ek GROUP BY 1),
  fam AS (SELECT entry_id, entity_id, pk, bridge, 'cath:' || d || '.' || (pk % 3) AS family FROM c3 WHERE pk % 4 = 0 UNION ALL SELECT entry_id, entity_id, pk, bridge, 'ecod:' || (d % 40) || '.' || (pk % 2) FROM c3 WHERE pk % 4 = 1
    UNION ALL SELECT entry_id, entity_id, pk, bridge, 'pfam:PF' || d || (pk % 2) FROM c3 WHERE pk % 6 = 0),
  fk AS (SELECT DISTINCT entry_id, family, coalesce(bridge, least_key) AS raw_key FROM fam JOIN lk USING (entry_id)),
  fl AS (SELECT entry_id, count(DISTINCT bridge) > 1 AS bridging, NOT bool_or(has_cluster) AS unclustered FROM c3 GROUP BY 1),
  sg AS (SELECT e.entry_id, coalesce('seqset:' || md5(string_agg(seq, chr(0) ORDER BY seq)), e.entry_id) AS sequence_group FROM {entries} e LEFT JOIN (SELECT entry_id, seq FROM ch WHERE known > 0) USING (entry_id) GROUP BY 1),
  fb AS (SELECT DISTINCT entry_id, (d % 40) || '.' || (pk % 2) AS family FROM c3 WHERE pk % 4 = 1),
  {_components_sql("sc", "SELECT entry_id AS g, raw_key FROM ek")}"""


def _components_sql(name: str, groups: str) -> str:
    """``name(entry_id, component)``: components of keys that share a group, by a label that sinks to the smallest key."""
    return f"""{name}_g AS (SELECT DISTINCT g, raw_key FROM ({groups})),
  {name}_l(raw_key, label, moved) AS (SELECT raw_key, raw_key, true FROM (SELECT DISTINCT raw_key FROM {name}_g)
    UNION ALL SELECT raw_key, n, bool_or(n < label) OVER () FROM (SELECT l.raw_key, min(l.label) AS label, min(o.m) AS n FROM {name}_l l JOIN {name}_g g ON g.raw_key = l.raw_key
      JOIN (SELECT g.g, min(l.label) AS m FROM {name}_l l JOIN {name}_g g ON g.raw_key = l.raw_key GROUP BY 1) o ON o.g = g.g WHERE l.moved GROUP BY 1)),
  {name}_m AS (SELECT raw_key, min(label) AS component FROM {name}_l GROUP BY 1),
  {name} AS (SELECT entry_id, component FROM lk JOIN {name}_m ON raw_key = least_key)"""


_MERGED = _components_sql("co", "SELECT 'e' || entry_id AS g, raw_key FROM ek UNION ALL SELECT 'f' || family, raw_key FROM fk")
_ALL = f"{_FLAT}, {_clustering_sql('en')}"


def _keyed(spark, sf_dir):
    return clusters.chain_keys(clusters.chains(chain_table(spark, sf_dir), CFG))


@query(f"{_ALL} SELECT entity_id AS chain, raw AS raw_key, bridge, known FROM c3")
def entry_chain_keys(spark, sf_dir):
    return _keyed(spark, sf_dir).select("chain", "raw_key", "bridge", F.col("known").cast("long").alias("known"))


@query(f"{_ALL} SELECT entry_id, raw_key FROM ek")
def entry_key_table(spark, sf_dir):
    return clusters.entry_keys(_keyed(spark, sf_dir))


@query(f"{_ALL} SELECT entry_id, bridging, unclustered FROM fl")
def entry_flag_table(spark, sf_dir):
    return clusters.entry_flags(_keyed(spark, sf_dir))


@query(f"{_ALL} SELECT entry_id, family, raw_key FROM fk")
def entry_family_keys(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    return clusters.family_keys(keyed, clusters.entry_keys(keyed), CFG.merge_authorities)


@query(f"{_ALL} SELECT entry_id, sequence_group FROM sg")
def entry_sequence_groups(spark, sf_dir):
    return clusters.sequence_groups(entry_table(spark, sf_dir), CFG)


@query(f"{_ALL}, {_MERGED} SELECT entry_id, co.component, sc.component AS sequence_component FROM co JOIN sc USING (entry_id)")
def entry_clusters(spark, sf_dir):
    return clusters.cluster_entries(chain_table(spark, sf_dir), CFG).both_components


@query(f"{_ALL} SELECT entry_id, family FROM fb")
def entry_fold_labels(spark, sf_dir):
    return clusters.cluster_entries(chain_table(spark, sf_dir), CFG).labels


@query(f"{_ALL} SELECT family, count(DISTINCT component) AS n_components FROM fk JOIN sc USING (entry_id) GROUP BY 1 HAVING count(DISTINCT component) > 1")
def entry_bridging_families(spark, sf_dir):
    found = clusters.cluster_entries(chain_table(spark, sf_dir), CFG)
    return clusters.bridging_families(found.families, found.sequence_components)


# --- builds and views ---------------------------------------------------------------------------

_UNIT = "(('0x' || substr(md5('entries:' || component), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"
_BUILD = f"""{_FILTER}, {_clustering_sql("kp")}, {_MERGED},
  es AS (SELECT entry_id, component, CASE WHEN {_UNIT} < 0.8::DOUBLE THEN 'train' WHEN {_UNIT} < {CFG.split_fractions.train + CFG.split_fractions.val!r}::DOUBLE THEN 'val' ELSE 'test' END AS split FROM co)"""
#: The tables of _TIERS over those of _BUILD, for kept entries.
_BUILD_TIERS = f"{_BUILD}, {_TIERS[len(_FLAT) + 1 :]}, kt AS (SELECT * FROM ti WHERE entry_id IN (SELECT entry_id FROM kp)), ka AS (SELECT * FROM ea WHERE entry_id IN (SELECT entry_id FROM kp))"
_TARGETS = """tgt AS (SELECT kt.entry_id, split, component AS cluster, CASE WHEN tier = 'functional' THEN class WHEN reason = 'glycan' THEN 'small_molecule' ELSE 'metal' END AS class,
    CASE WHEN would_be <> 'nucleic_acid' THEN comp_id END AS comp_id, tier, reason FROM kt JOIN es USING (entry_id) WHERE tier = 'functional' OR reason IN ('metal_site_nonnative', 'glycan'))"""


#: Builds by session and tables: the queries of this section look at one build, which is made once unless ``STAGED`` is cleared.
STAGED: dict[tuple[str, str], plans.Build] = {}


def _build(spark, sf_dir):
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in STAGED:
        STAGED[at] = plans.run_build(entry_table(spark, sf_dir), CFG)
    return STAGED[at]


@query(f"{_BUILD} SELECT entry_id, component, split FROM es")
def build_splits(spark, sf_dir):
    return _build(spark, sf_dir).splits


@query(f"{_BUILD_TIERS}, {_TARGETS} SELECT * FROM tgt")
def build_targets(spark, sf_dir):
    return _build(spark, sf_dir).targets


@query(f"{_BUILD} SELECT sha256(string_agg(entry_id || chr(9) || split || chr(10), '' ORDER BY entry_id)) AS sha256 FROM es")
def build_fingerprint(spark, sf_dir):
    return spark.createDataFrame([(plans.pair_fingerprint(_build(spark, sf_dir).splits, "entry_id", "split"),)], "sha256 string")


@query(f"""{_BUILD_TIERS}, {_TARGETS},
  sp(split) AS (VALUES ('train'), ('val'), ('test')),
  m AS (SELECT 'entries' AS what, split AS name, count(entry_id) AS n FROM sp LEFT JOIN es USING (split) GROUP BY 2
    UNION ALL SELECT 'components', split, count(DISTINCT component) FROM sp LEFT JOIN es USING (split) GROUP BY 2
    UNION ALL SELECT 'sequence_groups', split, count(DISTINCT sequence_group) FROM sp LEFT JOIN (es JOIN sg USING (entry_id)) USING (split) GROUP BY 2
    UNION ALL SELECT 'dropped', drop_reason, count(*) FROM fd WHERE drop_reason IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'tiers', tier || ':' || reason, count(*) FROM kt GROUP BY 2
    UNION ALL SELECT 'classes', split || ':' || c, count(*) FROM (SELECT split, unnest(classes_) AS c FROM ka JOIN es USING (entry_id)) GROUP BY 2
    UNION ALL SELECT 'ambiguous_classes', split || ':' || c, count(*) FROM (SELECT split, unnest(ambiguous_) AS c FROM ka JOIN es USING (entry_id)) GROUP BY 2
    UNION ALL SELECT 'targets', split || ':' || class || ':' || tier, count(*) FROM tgt GROUP BY 2
    UNION ALL SELECT 'totals', 'kept', count(*) FROM kp UNION ALL SELECT 'totals', 'bridging_entries', count(*) FROM fl WHERE bridging UNION ALL SELECT 'totals', 'unclustered_entries', count(*) FROM fl WHERE unclustered
    UNION ALL SELECT 'totals', 'sequence_components', count(DISTINCT component) FROM sc UNION ALL SELECT 'totals', 'purification_artifacts', count(*) FROM ka WHERE purification_artifact
    UNION ALL SELECT 'totals', 'bridging_families', count(*) FROM (SELECT family FROM fk JOIN sc USING (entry_id) GROUP BY 1 HAVING count(DISTINCT component) > 1))
  SELECT what, name, n FROM m""")
def build_counts(spark, sf_dir):
    told = plans.build_manifest(_build(spark, sf_dir))
    rows = [(what, s, counts[what]) for s, counts in told["counts"].items() for what in ("entries", "components", "sequence_groups")]
    rows += [(what, name, n) for what in ("dropped", "tiers", "targets") for name, n in told[what].items()]
    rows += [(what, f"{s}:{c}", n) for what in ("classes", "ambiguous_classes") for s, by in told[what].items() for c, n in by.items()]
    rows += [("totals", name, told[name]) for name in ("kept", "bridging_entries", "unclustered_entries", "sequence_components", "purification_artifacts", "bridging_families")]
    return spark.createDataFrame(rows, "what string, name string, n long")


_TRAIN_FAMILIES = "trf AS (SELECT DISTINCT family FROM fb JOIN es USING (entry_id) WHERE split = 'train')"


@query(f"""{_BUILD}, {_TRAIN_FAMILIES},
  nv AS (SELECT entry_id, split, bool_and(trf.family IS NULL) AS novel FROM fb JOIN es USING (entry_id) LEFT JOIN trf USING (family) GROUP BY 1, 2)
  SELECT (SELECT count(*) FROM es WHERE split = 'test') AS n_test, (SELECT count(*) FROM nv WHERE split = 'test') AS n_test_classified, (SELECT count(*) FROM nv WHERE split = 'test' AND novel) AS n_test_novel_fold,
    (SELECT count(DISTINCT family) FROM fb JOIN es USING (entry_id) WHERE split = 'test') AS n_test_distinct_folds,
    (SELECT count(DISTINCT fb.family) FROM fb JOIN es USING (entry_id) LEFT JOIN trf USING (family) WHERE split = 'test' AND trf.family IS NULL) AS n_test_novel_folds""")
def build_fold_benchmark(spark, sf_dir):
    built = _build(spark, sf_dir)
    return leakage.benchmark_summary(built.clusters.labels, built.splits)


def _view(spark, sf_dir, split: str) -> View:
    """A split of a build as the loader shows it."""
    built = _build(spark, sf_dir)
    entries = built.splits.where(F.col("split") == split)
    within = lambda df: df.join(entries.select("entry_id"), "entry_id", "left_semi")
    return View(entries, within(built.classes), within(built.targets), within(built.clusters.sequence_groups), within(leakage.novelty(built.clusters.labels, built.splits)), "md5")


@query(f"{_BUILD_TIERS} SELECT entry_id, component, split FROM es JOIN ka USING (entry_id) WHERE split = 'train' AND list_contains(classes_, 'metal')")
def view_with_class(spark, sf_dir):
    return _view(spark, sf_dir, "train").with_class("metal")


@query(f"{_BUILD_TIERS}, {_TARGETS} SELECT entry_id, string_agg(class || ':' || coalesce(comp_id, '') || ':' || reason, ',' ORDER BY class, comp_id NULLS FIRST, reason) AS targets FROM tgt WHERE split = 'train' AND class IN ('metal', 'nucleic_acid') GROUP BY 1")
def view_targets(spark, sf_dir):
    found = _view(spark, sf_dir, "train").targets_by_entry(classes=["metal", "nucleic_acid"], include_ambiguous=True)
    return found.select("entry_id", F.array_join(F.transform("targets", lambda t: F.concat(t["class"], F.lit(":"), F.coalesce(t["comp_id"], F.lit("")), F.lit(":"), t["reason"])), ",").alias("targets"))


@query(f"{_BUILD_TIERS}, {_TARGETS} SELECT DISTINCT entry_id, cluster AS component, split FROM tgt WHERE split = 'val' AND tier = 'functional' AND class = 'small_molecule'")
def view_conditioned_entries(spark, sf_dir):
    return _view(spark, sf_dir, "val").conditioned_entries(classes=["small_molecule"])


@query(f"{_BUILD} SELECT component AS grp, arg_min(entry_id, (md5('5:' || entry_id), entry_id)) AS entry_id, md5('5:' || component) AS group_rank FROM es WHERE split = 'train' GROUP BY component")
def view_sample_by_cluster(spark, sf_dir):
    return _view(spark, sf_dir, "train").sample_by_cluster(seed=5)


@query(f"{_BUILD} SELECT sequence_group, arg_min(entry_id, (md5('5:' || entry_id), entry_id)) AS entry_id, md5('5:' || sequence_group) AS group_rank FROM es JOIN sg USING (entry_id) WHERE split = 'train' GROUP BY sequence_group")
def view_sample_by_sequence(spark, sf_dir):
    return _view(spark, sf_dir, "train").sample_by_sequence(seed=5)


@query(f"{_BUILD} SELECT entry_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY sequence_group) AS weight FROM es JOIN sg USING (entry_id) WHERE split = 'train'")
def view_redundancy_weights(spark, sf_dir):
    return _view(spark, sf_dir, "train").redundancy_weights()


@query(f"""{_BUILD}, {_TRAIN_FAMILIES} SELECT entry_id, split, string_agg(DISTINCT fb.family, ',' ORDER BY fb.family) AS families FROM fb JOIN es USING (entry_id) LEFT JOIN trf USING (family) WHERE split = 'test' GROUP BY 1, 2 HAVING bool_and(trf.family IS NULL)""")
def view_novel_entries(spark, sf_dir):
    return _view(spark, sf_dir, "test").novel_entries().select("entry_id", "split", F.array_join("families", ",").alias("families"))


# --- raw objects and scalars --------------------------------------------------------------------


def raw_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``RAW_SCHEMA`` objects of all orders, as JSON text read back."""
    lines = chain_lines(spark, sf_dir).withColumn("k", F.col("pk") % 20)
    known = F.broadcast(spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(COMPONENTS)], "k long, comp_id string, formula string, comp_type string"))
    pk = F.col("pk")
    annotation = lambda kind, ident, name: F.struct(F.lit(kind).alias("type"), ident.alias("annotation_id"), name.alias("name"))
    said = F.array(annotation("Pfam", F.concat(F.lit("PF"), (pk % 7).cast("string")), F.lit("zinc finger")), annotation("InterPro", F.when(pk % 2 == 0, F.concat(F.lit("IPR"), (pk % 5).cast("string"))), F.lit("metal binding")), annotation("GO", F.lit("g"), F.when(pk % 3 == 0, F.lit("Nickel cation binding"))))
    held = F.array(annotation("CATH", F.concat_ws(".", pk % 4, pk % 3), F.lit("c")), annotation("ECOD", F.lit("e"), F.when(pk % 2 == 1, F.concat(F.lit("fold "), (pk % 6).cast("string")))))
    member = lambda c, i: F.struct(c.cast("int").alias("cluster_id"), F.lit(i).alias("identity"))
    polymer = F.struct(
        F.concat_ws("_", "o", "ln").alias("rcsb_id"), F.struct(F.when(pk % 5 != 0, F.lit("Protein")).alias("rcsb_entity_polymer_type"), F.concat(F.substring(sequence(), 1, 9), F.lit("\n "), F.substring(sequence(), 10, 99)).alias("pdbx_seq_one_letter_code_can")).alias("entity_poly"),
        F.when(pk % 3 != 0, F.array(member(pk % 50, 30), member(pk % 90, 90), member(pk % 60, 30))).alias("rcsb_cluster_membership"), said.alias("rcsb_polymer_entity_annotation"),
        F.when(pk % 7 != 0, F.array(F.struct(held.alias("rcsb_polymer_instance_annotation")), F.struct(F.lit(None).cast(held_type(spark, held)).alias("rcsb_polymer_instance_annotation")))).alias("polymer_entity_instances"),
    )
    score = F.array(F.struct(F.array(F.struct(F.when(F.col("ln") > 2, "Y").otherwise("N").alias("is_subject_of_investigation"))).alias("rcsb_nonpolymer_instance_validation_score")))
    part = F.struct(F.struct(F.struct(F.lower("comp_id").alias("id"), F.lit("n").alias("name"), "formula", F.col("comp_type").alias("type")).alias("chem_comp")).alias("nonpolymer_comp"), F.when(F.col("ln") % 2 == 1, score).alias("nonpolymer_entity_instances"))
    grouped = lines.join(known, "k", "left").groupBy("o").agg(F.collect_list(polymer).alias("polymer_entities"), F.collect_list(part).alias("nonpolymer_entities"), F.sort_array(F.collect_set("comp_id")).alias("ids"))
    o = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o", o).join(grouped, "o", "left")
    raw = rows.select(
        o.cast("string").alias("rcsb_id"), F.when(o % 4 != 0, F.array(F.struct(F.lit("X-RAY DIFFRACTION").alias("method")), F.struct(F.when(o % 4 == 1, F.lit("ELECTRON MICROSCOPY")).alias("method")))).alias("exptl"),
        F.struct(F.when(o % 3 != 0, F.array(F.col("o_totalprice") / 1000, F.lit(200.0))).alias("resolution_combined"), (o % 900).cast("int").alias("deposited_polymer_monomer_count"), F.transform("ids", lambda x: F.lower(x)).alias("nonpolymer_bound_components")).alias("rcsb_entry_info"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("initial_release_date")).alias("rcsb_accession_info"), F.when(o % 5 == 0, F.array(F.struct(F.lit("atp").alias("comp_id")), F.struct(F.lit(None).cast("string").alias("comp_id")))).alias("rcsb_binding_affinity"),
        "polymer_entities", "nonpolymer_entities",
        F.array(F.struct(F.lit("X-1").alias("rcsb_id"), F.struct((o % 70).cast("int").alias("polymer_monomer_count"), (o % 3).cast("int").alias("num_prot_na_interface_entities")).alias("rcsb_assembly_info"))).alias("assemblies"),
        F.when(o % 2 == 0, F.array(F.struct((o % 10).cast("double").alias("clashscore")))).alias("pdbx_vrpt_summary_geometry"),
    )
    return raw.select(F.from_json(F.to_json(F.struct(*raw.columns)), source.RAW_SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def held_type(spark: SparkSession, column: Column) -> str:
    return spark.range(1).withColumn("pk", F.col("id")).select(column.alias("x")).schema["x"].dataType.simpleString()


@query(f"""l1 AS (SELECT l_orderkey AS o, l_linenumber AS ln, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2),
  l2 AS (SELECT *, translate(md5((o // 10) || ':' || (pk % 6)), '0123456789abcdef', 'ACDEFGHIKLMNPQXH') AS s, o || '_' || ln AS entity_id FROM l1),
  ck(k, comp_id) AS (VALUES {', '.join(f"({k}, '{c[0]}')" for k, c in enumerate(COMPONENTS))}),
  p AS (SELECT *, {_SEQ} AS seq FROM l2),
  q AS (SELECT o, string_agg(entity_id || '/' || CASE WHEN pk % 5 <> 0 THEN 'Protein' ELSE 'Other' END || '/' || seq || '/' || CASE WHEN pk % 3 <> 0 THEN (pk % 60) || '/' || (pk % 90) ELSE '/' END || '/' || CASE WHEN pk % 3 = 0 THEN 'METAL+NI+ZN' ELSE 'METAL+ZN' END
      || '/' || CASE WHEN pk % 7 <> 0 THEN (pk % 4) || '.' || (pk % 3) ELSE '' END || '/' || CASE WHEN pk % 7 <> 0 AND pk % 2 = 1 THEN 'fold ' || (pk % 6) ELSE '' END || '/PF' || (pk % 7) || '/' || CASE WHEN pk % 2 = 0 THEN 'IPR' || (pk % 5) ELSE '' END, ';' ORDER BY entity_id) AS polymers FROM p GROUP BY 1),
  c AS (SELECT o, string_agg(DISTINCT comp_id, ',' ORDER BY comp_id) AS comps, coalesce(string_agg(DISTINCT comp_id, ',' ORDER BY comp_id) FILTER (WHERE ln > 2 AND ln % 2 = 1), '') AS investigated FROM l1 JOIN ck ON k = pk % 20 GROUP BY 1)
  SELECT o_orderkey::VARCHAR AS entry_id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ELECTRON MICROSCOPY,X-RAY DIFFRACTION' ELSE 'X-RAY DIFFRACTION' END AS methods, CASE WHEN o_orderkey % 3 <> 0 THEN least(o_totalprice / 1000, 200.0::DOUBLE) END AS resolution,
    strftime(o_orderdate, '%Y-%m-%d') AS released, (o_orderkey % 900)::INT AS deposited, (o_orderkey % 70)::INT AS assembly, coalesce(polymers, '') AS polymers, coalesce(comps, '') AS comps, coalesce(comps, '') AS bound, CASE WHEN o_orderkey % 5 = 0 THEN 'ATP' ELSE '' END AS affinity,
    coalesce(investigated, '') AS investigated, (o_orderkey % 3)::INT AS contacts, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 10)::DOUBLE END AS clashscore
  FROM orders LEFT JOIN q ON q.o = o_orderkey LEFT JOIN c ON c.o = o_orderkey""")
def raw_entries(spark, sf_dir):
    found = source.parse_raw(raw_objects(spark, sf_dir))
    at = lambda m, k: F.coalesce(F.array_join(F.try_element_at(m, F.lit(k)), "+"), F.lit(""))
    level = lambda p, k: F.coalesce(F.try_element_at(p["cluster_ids"], F.lit(k)).cast("string"), F.lit(""))
    polymers = F.transform("polymer_entities", lambda p: F.concat_ws("/", p["entity_id"], p["polymer_type"], p["seq"], level(p, "30"), level(p, "90"), F.array_join(p["metal_annotations"], "+"), at(p["structural_families"], "cath"), at(p["structural_families"], "ecod"), at(p["domain_families"], "pfam"), at(p["domain_families"], "interpro")))
    joined = lambda c: F.array_join(c, ",")
    return found.select(
        "entry_id", joined("methods").alias("methods"), F.col("resolution_A").alias("resolution"), F.col("release_date").alias("released"), F.col("deposited_residues").alias("deposited"), F.element_at("assemblies", "X-1").alias("assembly"),
        F.array_join(polymers, ";").alias("polymers"), joined(F.col("nonpolymer_comps.comp_id")).alias("comps"), joined("bound_components").alias("bound"), joined("affinity_comp_ids").alias("affinity"),
        joined("investigated_comp_ids").alias("investigated"), F.col("protein_na_interface_count").alias("contacts"), F.col("quality.clashscore").alias("clashscore"),
    )


@query(f"{_FLAT}, s AS (SELECT entity_id, seq, {_RUN.format('seq')} AS long, greatest({_RUN.format('substr(seq, 1, 20)')}, {_RUN.format('right(seq, 20)')}) AS edge FROM pe) "
       "SELECT entity_id AS chain, split_part(entity_id, '_', 1) AS entry_id, long >= 6 OR edge >= 3 AS tagged, length(regexp_replace(seq, '[Xx]', '', 'g'))::INT AS known_any, length(replace(seq, 'X', ''))::INT AS known FROM s")  # fmt: skip
def chain_texts(spark, sf_dir):
    rows = entry_table(spark, sf_dir).select(F.explode("polymer_entities").alias("e"))
    seq, chain = F.col("e.seq"), F.col("e.entity_id")
    return rows.select(chain.alias("chain"), tx.entry_of_chain(chain).alias("entry_id"), tx.has_tag(seq, CFG.histag_min_run, CFG.histag_terminal_min_run).alias("tagged"), tx.modeled_length(seq, True).alias("known_any"), tx.modeled_length(seq, False).alias("known"))


@query(f"""{_BUILD}, {_TRAIN_FAMILIES} SELECT split, count(DISTINCT entry_id) AS entries, count(DISTINCT fb.entry_id) AS classified, count(DISTINCT family) AS families, count(DISTINCT entry_id) - count(DISTINCT fb.entry_id) AS unclassified
  FROM es LEFT JOIN fb USING (entry_id) GROUP BY 1""".replace("count(DISTINCT fb.entry_id)", "count(DISTINCT CASE WHEN family IS NOT NULL THEN entry_id END)"))
def build_fold_coverage(spark, sf_dir):
    built = _build(spark, sf_dir)
    return audit.coverage(built.splits.select("entry_id", "split").join(built.clusters.labels, "entry_id", "left"), "split", "family")


@query(f"{_BUILD} SELECT component, count(*) AS size, {_UNIT} AS bucket FROM co GROUP BY 1")
def build_component_sizes(spark, sf_dir):
    kept, _ = filters.filter_entries(entry_table(spark, sf_dir), CFG)
    return assign.with_bucket(assign.component_sizes(clusters.cluster_entries(kept, CFG).components), CFG.split_salt, CFG.hash_name)


# --- audits of entries --------------------------------------------------------------------------

_METHODS = """lb AS (SELECT DISTINCT entry_id, split_part(family, ':', 1) AS method, substr(family, length(split_part(family, ':', 1)) + 2) AS family FROM fam)"""


def _labels(spark, sf_dir) -> DataFrame:
    """``(entry_id, method, family, raw_key)`` of the chains of all entries."""
    keyed = _keyed(spark, sf_dir)
    rows = clusters.family_keys(keyed, clusters.entry_keys(keyed), CFG.merge_authorities)
    name = F.split_part("family", F.lit(":"), F.lit(1))
    return rows.select("entry_id", name.alias("method"), F.expr("substr(family, length(split_part(family, ':', 1)) + 2)").alias("family"), "raw_key")


def _kept_labels(spark, sf_dir, built) -> DataFrame:
    return _labels(spark, sf_dir).select("entry_id", "method", "family").distinct().join(built.splits.select("entry_id"), "entry_id", "left_semi")


@query(f"""{_BUILD_TIERS}, {_METHODS},
  lc AS (SELECT * FROM lb UNION ALL SELECT entry_id, 'combined', method || ':' || family FROM lb),
  ls AS (SELECT lc.*, split FROM lc JOIN es USING (entry_id)), lt AS (SELECT DISTINCT method, family FROM ls WHERE split = 'train'),
  lj AS (SELECT entry_id, ls.method, bool_or(lt.family IS NOT NULL) AS seen FROM ls LEFT JOIN lt ON lt.method = ls.method AND lt.family = ls.family WHERE split <> 'train' GROUP BY 1, 2),
  la AS (SELECT es.entry_id, split, m.method, seen FROM es CROSS JOIN (VALUES ('cath'), ('ecod'), ('pfam'), ('combined')) m(method) LEFT JOIN lj ON lj.entry_id = es.entry_id AND lj.method = m.method WHERE split <> 'train'),
  lx AS (SELECT la.*, c AS class FROM la JOIN (SELECT entry_id, unnest(classes_) AS c FROM ka) USING (entry_id) UNION ALL SELECT *, NULL FROM la)
  SELECT method, class, split, count(*) FILTER (WHERE seen) AS seen, count(*) FILTER (WHERE NOT seen) AS novel, count(*) FILTER (WHERE seen IS NULL) AS unclassified FROM lx GROUP BY 1, 2, 3""")
def build_novelty_by_class(spark, sf_dir):
    built = _build(spark, sf_dir)
    classes = built.classes.select("entry_id", F.explode("classes").alias("class"))
    return audit.novelty_by_class(_kept_labels(spark, sf_dir, built), built.splits, classes, ["cath", "ecod", "pfam"])


@query(f"""{_TIERS}, pb AS (SELECT DISTINCT entry_id, CASE WHEN metal THEN 'metal' ELSE 'small_molecule' END AS class FROM np),
  pj AS (SELECT pb.class, pb.entry_id, bool_or(would_be = pb.class AND tier = 'functional') AS functional FROM pb JOIN ti USING (entry_id) GROUP BY 1, 2),
  pw AS (SELECT pj.class, reason, count(*) AS n FROM pj JOIN ti ON ti.entry_id = pj.entry_id AND would_be = pj.class WHERE NOT functional GROUP BY 1, 2),
  pr AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, reason) AS place FROM pw)
  SELECT class, count(*) AS entries, count(*) FILTER (WHERE functional) AS functional, count(*) FILTER (WHERE NOT functional) AS other,
    (SELECT string_agg(reason || '=' || n, ',' ORDER BY place) FROM pr WHERE pr.class = pj.class AND place <= 3) AS reasons FROM pj GROUP BY 1""")
def entry_class_contamination(spark, sf_dir):
    found = tiers.component_tiers(entry_table(spark, sf_dir), CFG)
    published = found.where("comp_id <> 'nucleic_acid'").select("entry_id", F.col("would_be").alias("class"))
    told = F.transform("reasons", lambda r: F.concat(r["reason"], F.lit("="), r["n"].cast("string")))
    return audit.class_contamination(found, published, 3).withColumn("reasons", F.array_join(told, ","))


@query(f"""{_TIERS}, su AS (SELECT entry_id FROM ef WHERE lone OR artifact), ru AS (SELECT entry_id, max({_RUN.format("seq")}) AS run FROM pe WHERE protein GROUP BY 1)
  SELECT r AS min_run, count(*) AS entries, count(*) FILTER (WHERE run >= r) AS tagged, count(*) FILTER (WHERE run >= r) / count(*)::DOUBLE AS fraction
  FROM su LEFT JOIN ru USING (entry_id), (VALUES (6), (5), (4)) v(r) GROUP BY 1""")
def entry_tag_audit(spark, sf_dir):
    table = entry_table(spark, sf_dir)
    ions = F.transform(F.filter("nonpolymer_comps", lambda c: tiers.is_metal_ion(c["comp_id"], c["formula"])), lambda c: c["comp_id"])
    lone = table.where((F.size(ions) > 0) & (F.size(F.array_except(ions, F.array(F.lit("NI"), F.lit("CO")))) == 0)).select("entry_id")
    sequences = table.select("entry_id", F.explode(F.filter("polymer_entities", filters.is_protein)).alias("e")).select("entry_id", F.col("e.seq").alias("seq"))
    return audit.tag_audit(sequences, lone)


@query(f"""{_FLAT}, pc AS (SELECT entity_id, pk FROM pe WHERE protein), s AS (SELECT *, pk % 4 = 1 AS ecod, pk % 4 = 0 OR pk % 6 = 0 AS other, CASE WHEN pk % 7 = 0 THEN pk % 2 = 0 END AS sampled FROM pc)
  SELECT count(*) AS entries, count(*) FILTER (WHERE NOT ecod) AS unclassified, count(*) FILTER (WHERE NOT ecod AND other) AS suspects, count(*) FILTER (WHERE NOT ecod AND other AND sampled IS NOT NULL) AS sampled,
    count(*) FILTER (WHERE NOT ecod AND other AND sampled) AS confirmed, count(*) FILTER (WHERE NOT ecod AND other AND sampled) / count(*) FILTER (WHERE NOT ecod AND other AND sampled IS NOT NULL)::DOUBLE AS rate,
    count(*) FILTER (WHERE NOT ecod AND other AND sampled) / count(*) FILTER (WHERE NOT ecod AND other AND sampled IS NOT NULL)::DOUBLE * count(*) FILTER (WHERE NOT ecod AND other) AS projected FROM s""")
def entry_gap_projection(spark, sf_dir):
    """Chains that the benchmark's authority lacks although another one has them; a seventh of the parts is looked up."""
    rows = entry_table(spark, sf_dir).select(F.explode(F.filter("polymer_entities", filters.is_protein)).alias("e"))
    parts = chain_lines(spark, sf_dir).select(F.concat_ws("_", "o", "ln").alias("entry_id"), "pk")
    chains = rows.select(F.col("e.entity_id").alias("entry_id"), F.map_contains_key("e.structural_families", F.lit("ecod")).alias("ecod"), (F.map_contains_key("e.structural_families", F.lit("cath")) | F.map_contains_key("e.domain_families", F.lit("pfam"))).alias("other")).join(parts, "entry_id")
    return audit.gap_projection(chains, chains.where("ecod"), F.col("other"), F.when(F.col("pk") % 7 == 0, F.col("pk") % 2 == 0))


def _sweep_sql(method: str) -> str:
    return _components_sql(f"w{method}", f"SELECT 'e' || entry_id AS g, raw_key FROM ek UNION ALL SELECT family, raw_key FROM fk WHERE family LIKE '{method}:%'")


@query(f"""{_ALL}, {", ".join(map(_sweep_sql, ("cath", "ecod", "pfam")))},
  base AS (SELECT count(DISTINCT component) AS n FROM sc), br AS (SELECT family, count(DISTINCT component) AS n FROM fk JOIN sc USING (entry_id) GROUP BY 1),
  cn AS (SELECT 'cath' AS method, count(DISTINCT component) AS components FROM wcath UNION ALL SELECT 'ecod', count(DISTINCT component) FROM wecod UNION ALL SELECT 'pfam', count(DISTINCT component) FROM wpfam)
  SELECT method, (SELECT count(DISTINCT entry_id) FROM fk WHERE family LIKE method || ':%') AS covered, components, (SELECT n FROM base) - components AS folded, (SELECT count(*) FROM br WHERE n > 1 AND family LIKE method || ':%') AS bridging FROM cn""")
def entry_authority_sweep(spark, sf_dir):
    chain = clusters.chains(chain_table(spark, sf_dir), CFG)
    return audit.authority_sweep(clusters.links(chain, CFG.merge_authorities), ["cath", "ecod", "pfam"])


@query(f"""{_FLAT}, e AS (SELECT entity_id, upper(seq) AS t, greatest({_RUN.format("substr(seq, 1, 20)")}, {_RUN.format("right(seq, 20)")}) AS edge FROM pe),
  c AS (SELECT entity_id, unnest(range(1, length(t) + 1)) AS i, t FROM e WHERE edge >= 2), b AS (SELECT entity_id, i, length(t) AS n, length(regexp_extract(substr(t, i), '^H+')) AS r FROM c WHERE substr(t, i, 1) = 'H' AND (i = 1 OR substr(t, i - 1, 1) <> 'H'))
  SELECT entity_id AS chain, coalesce(string_agg(i || '-' || (i + r - 1), ',' ORDER BY i) FILTER (WHERE r >= 2 AND (i <= 20 OR i + r - 1 > n - 20)), '') AS spans FROM e LEFT JOIN b USING (entity_id) GROUP BY 1""")
def chain_run_spans(spark, sf_dir):
    rows = entry_table(spark, sf_dir).select(F.explode("polymer_entities").alias("e"))
    return rows.select(F.col("e.entity_id").alias("chain"), F.array_join(F.transform(tx.run_spans(F.col("e.seq"), "H", 2), lambda s: F.concat_ws("-", s["start"], s["stop"])), ",").alias("spans"))


@query(f"{_BUILD} SELECT split, 100.0::DOUBLE * count(fb.entry_id) / count(*) AS pct FROM es LEFT JOIN (SELECT DISTINCT entry_id FROM fb) fb USING (entry_id) GROUP BY 1")
def build_coverage_percent(spark, sf_dir):
    covered = build_fold_coverage(spark, sf_dir)
    return covered.select("split", tx.percent(F.col("classified"), F.col("entries")).alias("pct"))
