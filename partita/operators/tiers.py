"""Tiers of attached components: one ladder of conditions, labels instead of deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.config import Config
from partita.functions.text import formula_elements, has_tag, is_saccharide
from partita.operators.filters import is_nucleic, is_protein

# Component and element sets.
METAL_ELEMENTS = (
    "LI BE NA MG AL K CA SC TI V CR MN FE CO NI CU ZN GA RB SR Y ZR NB MO TC RU RH PD AG CD IN SN CS BA LA CE PR ND PM SM EU GD TB DY HO ER TM YB LU "
    "HF TA W RE OS IR PT AU HG TL PB BI"
).split()
COUNTERIONS = "NA CL K BR I IOD CS RB F LI".split()
PHASING_METALS = "HG AU PT PB TL OS IR LA CE PR ND SM EU GD TB DY HO ER TM YB LU".split()
ADDITIVES = (
    "HOH DOD GOL EDO PEG PG4 PGE 1PE 2PE P6G PE4 PE3 PE5 PG0 PG5 PG6 7PE 12P 15P XPE PEU P4G MPD MRD P33 BU3 BU1 BU2 MOH EOH IPA PDO PGO PGR "
    "SO4 PO4 ACT ACY FMT EPE MES TRS BTB BIS CAC SCN AZI NO3 CO3 FLC TLA CIT MLI IOD TAR IMD BCN BME DTT DTU TCE DMS BOG OLC LDA C8E SDS DAO HED"
).split()

METAL_CLUSTERS = "FES SF4 F3S CFM CFN CLF ICS OEC OEX".split()

METAL, SMALL_MOLECULE, NUCLEIC_ACID = "metal", "small_molecule", "nucleic_acid"
FUNCTIONAL, AMBIGUOUS, ARTIFACT = "functional", "ambiguous", "artifact"


def ladder(arms: list[tuple[Column, str, str, str | None]]) -> Column:
    """A struct ``(tier, reason, class)`` of the first condition that holds; null conditions don't."""
    out = F.lit(None).cast("struct<tier:string,reason:string,class:string>")
    for condition, tier, reason, label in reversed(arms):
        value = F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"), F.lit(label).cast("string").alias("class"))
        out = F.when(F.coalesce(condition, F.lit(False)), value).otherwise(out)
    return out


def component_ladder(cfg: Config) -> Column:
    """Tier of a component from its flags: metal_site, affinity, annotated, investigated, bound, saccharide and the entry's flags."""
    comp, metal = F.col("comp_id"), F.col("metal_site")
    purification = comp.isin(list(cfg.purification_metals)) if cfg.purification_metals else F.lit(False)
    lone = F.col("lone_purification_metal") & purification & ~F.col("affinity") & ~F.col("investigated") & ~F.col("annotated")
    tagged = F.col("purification_artifact") & purification & F.lit(cfg.exclude_purification_artifacts)
    organic = ~metal
    return ladder([
        (comp.isin(COUNTERIONS), ARTIFACT, "counterion", None),
        (metal & F.col("affinity"), FUNCTIONAL, "metal_affinity", METAL),
        (metal & F.col("annotated"), FUNCTIONAL, "metal_annotated", METAL),
        (metal & F.col("investigated"), FUNCTIONAL, "metal_investigated", METAL),
        (metal & comp.isin(PHASING_METALS), AMBIGUOUS, "phasing_metal", None),
        (metal & tagged, ARTIFACT, "histag_metal", None),
        (metal & lone & (F.size("annotated_metals") > 0), AMBIGUOUS, "metal_site_nonnative", None),
        (metal & lone, AMBIGUOUS, "purification_metal_uncorroborated", None),
        (metal & F.col("bound"), FUNCTIONAL, "metal_bound", METAL),
        (metal, AMBIGUOUS, "metal_unbound", None),
        (organic & F.col("affinity"), FUNCTIONAL, "ligand_affinity", SMALL_MOLECULE),
        (organic & F.col("saccharide"), AMBIGUOUS, "glycan", None),
        (organic & F.col("investigated"), FUNCTIONAL, "ligand_investigated", SMALL_MOLECULE),
        (organic & comp.isin(ADDITIVES + list(cfg.excluded_het)), ARTIFACT, "additive", None),
        (organic & F.col("bound"), FUNCTIONAL, "ligand_bound", SMALL_MOLECULE),
        (organic, AMBIGUOUS, "ligand_unbound", None),
    ])


def is_metal_ion(comp_id: Column, formula: Column) -> Column:
    """Only metals in the formula; without a formula the identifier must be a metal's symbol."""
    found = formula_elements(formula)
    elements = F.when(F.size(found) > 0, found).otherwise(F.array(comp_id))
    return (F.size(elements) > 0) & (F.size(F.array_except(elements, F.array(*map(F.lit, METAL_ELEMENTS)))) == 0)


def component_tiers(entries: DataFrame, cfg: Config) -> DataFrame:
    """``entry_id, comp_id, tier, reason, class, would_be, purification_artifact``: a row for each component, and one for nucleic acid.

    Everything an entry's components need of their entry stands in
    arrays of its row, so no join and no shuffle is needed.
    """
    sites = F.filter("nonpolymer_comps", lambda c: is_metal_ion(c["comp_id"], c["formula"]))
    ions = F.transform(sites, lambda c: c["comp_id"])
    purification = F.array(*map(F.lit, cfg.purification_metals)).cast("array<string>")
    all_purification = (F.size(ions) > 0) & (F.size(F.array_except(ions, purification)) == 0)
    proteins = F.filter("polymer_entities", is_protein)
    tag = F.exists(proteins, lambda e: has_tag(e["seq"], cfg.histag_min_run, cfg.histag_terminal_min_run))
    flagged = entries.select(
        "entry_id", "nonpolymer_comps", "bound_components", "affinity_comp_ids", "investigated_comp_ids",
        F.array_distinct(F.flatten(F.transform(proteins, lambda e: e["metal_annotations"]))).alias("annotated_metals"),
        F.coalesce(all_purification & tag, F.lit(False)).alias("purification_artifact"),
        F.coalesce(all_purification & ~tag, F.lit(False)).alias("lone_purification_metal"),
        F.exists("polymer_entities", is_nucleic).alias("has_nucleic"),
        (F.coalesce("protein_na_interface_count", F.lit(0)) > 0).alias("na_interface"),
    )
    rows = flagged.withColumn("c", F.explode("nonpolymer_comps")).withColumn("comp_id", F.col("c.comp_id"))
    rows = rows.withColumn("metal_site", is_metal_ion(F.col("comp_id"), F.col("c.formula")) | F.col("comp_id").isin(METAL_CLUSTERS))
    for flag, ids in (("bound", "bound_components"), ("affinity", "affinity_comp_ids"), ("investigated", "investigated_comp_ids"), ("annotated", "annotated_metals")):
        rows = rows.withColumn(flag, F.coalesce(F.array_contains(ids, F.col("comp_id")), F.lit(False)))
    rows = rows.withColumn("saccharide", is_saccharide(F.col("c.comp_type"))).withColumn("t", component_ladder(cfg))
    would_be = F.when(F.col("metal_site"), METAL).otherwise(SMALL_MOLECULE)
    rows = rows.select("entry_id", "comp_id", "t.tier", "t.reason", "t.class", would_be.alias("would_be"), "purification_artifact")
    nucleic = flagged.where("has_nucleic").select(
        "entry_id", F.lit("nucleic_acid").alias("comp_id"), F.when(F.col("na_interface"), FUNCTIONAL).otherwise(AMBIGUOUS).alias("tier"),
        F.when(F.col("na_interface"), "protein_na_interface").otherwise("no_protein_na_interface").alias("reason"),
        F.when(F.col("na_interface"), NUCLEIC_ACID).alias("class"), F.lit(NUCLEIC_ACID).alias("would_be"), "purification_artifact",
    )
    return rows.unionByName(nucleic)


def entry_classes(tiers: DataFrame) -> DataFrame:
    """A row for each entry with components: its classes, ambiguous classes, components by kind and tiers."""
    functional = F.col("tier") == FUNCTIONAL
    pick = lambda value, when: F.array_sort(F.collect_set(F.when(when, value)))
    out = tiers.groupBy("entry_id").agg(
        pick(F.col("class"), functional).alias("classes"),
        pick(F.col("would_be"), F.col("tier") == AMBIGUOUS).alias("maybe"),
        pick(F.col("comp_id"), functional & (F.col("class") == METAL)).alias("metals"),
        pick(F.col("comp_id"), functional & (F.col("class") == SMALL_MOLECULE)).alias("small_molecules"),
        F.bool_or(F.col("would_be") == NUCLEIC_ACID).alias("has_nucleic_acid"),
        F.bool_or("purification_artifact").alias("purification_artifact"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("comp_id", F.struct("tier", "reason").alias("t"))))).alias("tiers"),
    )
    return out.withColumn("ambiguous_classes", F.array_except("maybe", "classes")).drop("maybe")


def conditioning_targets(tiers: DataFrame, entry_split: DataFrame, entry_component: DataFrame) -> DataFrame:
    """A row for each structure and component worth conditioning on; some ambiguous ones are offered as such."""
    offered = F.col("reason").isin("metal_site_nonnative", "glycan")
    chosen = tiers.where((F.col("tier") == FUNCTIONAL) | (F.col("tier") == AMBIGUOUS) & offered)
    label = F.when(F.col("tier") == FUNCTIONAL, F.col("class")).when(F.col("reason") == "glycan", SMALL_MOLECULE).otherwise(METAL)
    comp = F.when(F.col("would_be") != NUCLEIC_ACID, F.col("comp_id"))
    chosen = chosen.select("entry_id", label.alias("class"), comp.alias("comp_id"), "tier", "reason")
    out = chosen.join(entry_split.select("entry_id", "split"), "entry_id").join(entry_component.select("entry_id", "component"), "entry_id", "left")
    return out.select("entry_id", "split", F.coalesce("component", "entry_id").alias("cluster"), "class", "comp_id", "tier", "reason")


def tier_histogram(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy(F.concat_ws(":", "tier", "reason").alias("tier_reason")).agg(F.count("*").alias("n"))
