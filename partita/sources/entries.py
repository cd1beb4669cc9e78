"""The entry table: schema, typed parsing of raw API objects, canonical JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.config import AUTHORITIES, STRUCTURAL, Config
from partita.functions.hashing import canonical_json
from partita.functions.text import metal_symbols, release_date, without_space

_FAMILIES = "map<string,array<string>>"
ENTRY_SCHEMA = f"""
entry_id string, methods array<string>, resolution_A double, release_date string, deposited_residues int, assemblies map<string,int>,
polymer_entities array<struct<entity_id:string,polymer_type:string,seq_len:int,seq:string,cluster_ids:map<string,int>,metal_annotations:array<string>,
structural_families:{_FAMILIES},domain_families:{_FAMILIES}>>,
nonpolymer_comps array<struct<comp_id:string,name:string,formula:string,comp_type:string>>,
bound_components array<string>, affinity_comp_ids array<string>, investigated_comp_ids array<string>, protein_na_interface_count int,
quality struct<clashscore:double,ramachandran_outlier_pct:double,rotamer_outlier_pct:double,rfree:double,rsrz_outlier_pct:double,em_backbone_inclusion:double>
"""
_ANNOTATION = "array<struct<type:string,annotation_id:string,name:string>>"
#: What is asked of the API, as it comes.
RAW_SCHEMA = f"""
rcsb_id string, exptl array<struct<method:string>>,
rcsb_entry_info struct<resolution_combined:array<double>,deposited_polymer_monomer_count:int,nonpolymer_bound_components:array<string>>,
rcsb_accession_info struct<initial_release_date:string>, rcsb_binding_affinity array<struct<comp_id:string>>,
polymer_entities array<struct<rcsb_id:string,entity_poly:struct<rcsb_entity_polymer_type:string,pdbx_seq_one_letter_code_can:string>,
rcsb_cluster_membership:array<struct<cluster_id:int,identity:int>>,rcsb_polymer_entity_annotation:{_ANNOTATION},
polymer_entity_instances:array<struct<rcsb_polymer_instance_annotation:{_ANNOTATION}>>>>,
nonpolymer_entities array<struct<nonpolymer_comp:struct<chem_comp:struct<id:string,name:string,formula:string,type:string>>,
nonpolymer_entity_instances:array<struct<rcsb_nonpolymer_instance_validation_score:array<struct<is_subject_of_investigation:string>>>>>>,
assemblies array<struct<rcsb_id:string,rcsb_assembly_info:struct<polymer_monomer_count:int,num_prot_na_interface_entities:int>>>,
pdbx_vrpt_summary_geometry array<struct<clashscore:double,percent_ramachandran_outliers:double,percent_rotamer_outliers:double>>,
pdbx_vrpt_summary_diffraction array<struct<DCC_Rfree:double,percent_RSRZ_outliers:double>>,
pdbx_vrpt_summary_em array<struct<atom_inclusion_backbone:double>>
"""
# What an annotation's type is called here, and which of its fields names the family.
_INSTANCE = {"cath": ("CATH", "annotation_id"), "ecod": ("ECOD", "name"), "scop2": ("SCOP2", "name")}
_ENTITY = {"pfam": ("Pfam", "annotation_id"), "interpro": ("InterPro", "annotation_id")}


def _list(column: Column, kind: str) -> Column:
    return F.coalesce(column, F.array().cast(kind))


def _sorted_set(column: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(_list(column, "array<string>"))))


def _family_map(annotations: Column, named: dict[str, tuple[str, str]]) -> Column:
    """Authority to its sorted families; authorities without any are left out."""

    def of(name: str, kind: str, field: str) -> Column:
        held = F.filter(annotations, lambda a: (a["type"] == kind) & (F.coalesce(a[field], F.lit("")) != ""))
        return F.struct(F.lit(name).alias("key"), _sorted_set(F.transform(held, lambda a: a[field])).alias("value"))

    pairs = [of(name, *which) for name, which in named.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.size(p["value"]) > 0))


def _polymer(p: Column) -> Column:
    seq = without_space(p["entity_poly"]["pdbx_seq_one_letter_code_can"])
    annotations = _list(p["rcsb_polymer_entity_annotation"], _ANNOTATION)
    instances = F.flatten(F.transform(p["polymer_entity_instances"], lambda i: _list(i["rcsb_polymer_instance_annotation"], _ANNOTATION)))
    member = F.filter(_list(p["rcsb_cluster_membership"], "array<struct<cluster_id:int,identity:int>>"), lambda m: m["identity"].isNotNull() & m["cluster_id"].isNotNull())
    # Of repeated levels the last counts.
    levels = F.array_distinct(F.transform(member, lambda m: m["identity"]))
    last = lambda level: F.element_at(F.filter(member, lambda m: m["identity"] == level), -1)["cluster_id"]
    clusters = F.map_from_entries(F.transform(levels, lambda v: F.struct(v.cast("string").alias("key"), last(v).alias("value"))))
    return F.struct(
        p["rcsb_id"].alias("entity_id"), F.coalesce(p["entity_poly"]["rcsb_entity_polymer_type"], F.lit("Other")).alias("polymer_type"),
        F.length(seq).alias("seq_len"), seq.alias("seq"), clusters.alias("cluster_ids"),
        _sorted_set(F.flatten(F.transform(annotations, lambda a: metal_symbols(a["name"])))).alias("metal_annotations"),
        _family_map(_list(instances, _ANNOTATION), _INSTANCE).alias("structural_families"), _family_map(annotations, _ENTITY).alias("domain_families"),
    )


def parse_raw(raw: DataFrame) -> DataFrame:
    """Raw API objects (``RAW_SCHEMA``) as entries; one projection, no shuffle."""
    parts = F.filter(_list(F.col("nonpolymer_entities"), raw.schema["nonpolymer_entities"].dataType.simpleString()), lambda n: F.coalesce(n["nonpolymer_comp"]["chem_comp"]["id"], F.lit("")) != "")
    name = lambda n: F.upper(n["nonpolymer_comp"]["chem_comp"]["id"])
    ids = F.array_sort(F.array_distinct(F.transform(parts, name)))
    first = lambda c: F.get(F.filter(parts, lambda n: name(n) == c), F.lit(0))["nonpolymer_comp"]["chem_comp"]
    comps = F.transform(ids, lambda c: F.struct(c.alias("comp_id"), first(c)["name"].alias("name"), first(c)["formula"].alias("formula"), first(c)["type"].alias("comp_type")))
    of_interest = F.filter(parts, lambda n: F.exists(_scores(n), lambda s: s["is_subject_of_investigation"] == "Y"))
    assemblies = F.coalesce(F.col("assemblies"), F.array().cast(raw.schema["assemblies"].dataType))
    counted = F.filter(assemblies, lambda a: a["rcsb_id"].isNotNull() & a["rcsb_assembly_info"]["polymer_monomer_count"].isNotNull())
    sizes = F.map_from_entries(F.transform(counted, lambda a: F.struct(a["rcsb_id"].alias("key"), a["rcsb_assembly_info"]["polymer_monomer_count"].alias("value"))))
    contacts = F.aggregate(assemblies, F.lit(0), lambda acc, a: acc + F.coalesce(a["rcsb_assembly_info"]["num_prot_na_interface_entities"], F.lit(0)))
    geometry, diffraction, em = (F.get(f"pdbx_vrpt_summary_{x}", F.lit(0)) for x in ("geometry", "diffraction", "em"))
    polymers = F.coalesce(F.col("polymer_entities"), F.array().cast(raw.schema["polymer_entities"].dataType))
    return raw.select(
        F.col("rcsb_id").alias("entry_id"),
        F.array_sort(F.filter(F.transform(F.coalesce("exptl", F.array().cast("array<struct<method:string>>")), lambda m: m["method"]), lambda m: F.coalesce(m, F.lit("")) != "")).alias("methods"),
        F.array_min("rcsb_entry_info.resolution_combined").alias("resolution_A"),
        release_date(F.col("rcsb_accession_info.initial_release_date")).alias("release_date"),
        F.col("rcsb_entry_info.deposited_polymer_monomer_count").alias("deposited_residues"), sizes.alias("assemblies"),
        F.array_sort(F.transform(polymers, _polymer), lambda a, b: F.when(a["entity_id"] < b["entity_id"], -1).when(a["entity_id"] > b["entity_id"], 1).otherwise(0)).alias("polymer_entities"),
        comps.alias("nonpolymer_comps"),
        _sorted_set(F.transform("rcsb_entry_info.nonpolymer_bound_components", F.upper)).alias("bound_components"),
        _sorted_set(F.transform("rcsb_binding_affinity", lambda a: F.upper(a["comp_id"]))).alias("affinity_comp_ids"),
        _sorted_set(F.transform(of_interest, name)).alias("investigated_comp_ids"), contacts.alias("protein_na_interface_count"),
        F.struct(
            geometry["clashscore"].alias("clashscore"), geometry["percent_ramachandran_outliers"].alias("ramachandran_outlier_pct"),
            geometry["percent_rotamer_outliers"].alias("rotamer_outlier_pct"), diffraction["DCC_Rfree"].alias("rfree"),
            diffraction["percent_RSRZ_outliers"].alias("rsrz_outlier_pct"), em["atom_inclusion_backbone"].alias("em_backbone_inclusion"),
        ).alias("quality"),
    )


def _scores(n: Column) -> Column:
    kind = "array<struct<is_subject_of_investigation:string>>"
    return F.coalesce(F.flatten(F.transform(n["nonpolymer_entity_instances"], lambda i: _list(i["rcsb_nonpolymer_instance_validation_score"], kind))), F.array().cast(kind))


def scan(entries: DataFrame, cfg: Config, limit: int | None = None) -> DataFrame:
    """What a snapshot selects: an enabled method, the loosest cap, released by the date; the filter checks the exact caps."""
    methods = F.arrays_overlap("methods", F.array(*map(F.lit, cfg.experimental_methods)))
    fits = F.col("resolution_A").isNull() | (F.col("resolution_A") <= cfg.loosest_resolution)
    out = entries.where(methods & fits & (F.col("release_date") <= cfg.snapshot_date.isoformat()))
    return out.orderBy("entry_id").limit(limit) if limit is not None else out


def count_entries(entries: DataFrame, cfg: Config) -> int:
    return scan(entries, cfg).count()


def read_entries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Entries from JSON lines; blank lines are skipped, a bad line fails the read, missing late fields get defaults."""
    out = spark.read.schema(ENTRY_SCHEMA).option("mode", "FAILFAST").json(path).where("entry_id is not null")
    empty = F.map_from_arrays(F.array(), F.array()).cast(_FAMILIES)
    patched = F.transform("polymer_entities", lambda e: e.withField("domain_families", F.coalesce(e["domain_families"], empty)).withField("structural_families", F.coalesce(e["structural_families"], empty)))
    return out.withColumn("polymer_entities", patched).withColumn("protein_na_interface_count", F.coalesce("protein_na_interface_count", F.lit(0)))


def canonical_lines(entries: DataFrame) -> DataFrame:
    """``(entry_id, line)``: canonical JSON of each entry, nulls kept."""
    record = F.to_json(F.struct(*entries.columns), {"ignoreNullFields": "false"})
    return entries.select("entry_id", canonical_json(record).alias("line"))


def write_entries_jsonl(entries: DataFrame, path: str) -> None:
    """Sorted canonical lines; files follow one another in the order of identifiers."""
    canonical_lines(entries).repartitionByRange("entry_id").sortWithinPartitions("entry_id").select("line").write.mode("overwrite").text(path)


def content_fingerprint(entries: DataFrame) -> str:
    """SHA-256 of the canonical snapshot: lines in order, streamed through the driver, never one string."""
    import hashlib

    digest = hashlib.sha256()
    for row in canonical_lines(entries).orderBy("entry_id").select("line").toLocalIterator():
        digest.update(f"{row['line']}\n".encode())
    return digest.hexdigest()


def with_annotations(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """``domain_families`` of chains from ``cache(entity_id, pfam, interpro)``; chains that it lacks keep theirs."""
    chains = entries.select("entry_id", F.explode("polymer_entities").alias("e")).join(cache.withColumnRenamed("entity_id", "id"), F.col("e.entity_id") == F.col("id"), "left")
    pairs = F.array(*[F.struct(F.lit(a).alias("key"), _sorted_set(F.col(a)).alias("value")) for a in AUTHORITIES if a not in STRUCTURAL])
    held = F.map_from_entries(F.filter(pairs, lambda p: F.size(p["value"]) > 0))
    new = chains.select("entry_id", F.when(F.col("id").isNull(), F.col("e")).otherwise(F.col("e").withField("domain_families", held)).alias("e"))
    order = lambda a, b: F.when(a["entity_id"] < b["entity_id"], -1).when(a["entity_id"] > b["entity_id"], 1).otherwise(0)
    packed = new.groupBy("entry_id").agg(F.array_sort(F.collect_list("e"), order).alias("new"))
    out = entries.join(packed, "entry_id", "left")
    return out.withColumn("polymer_entities", F.coalesce("new", "polymer_entities")).drop("new").select(*entries.columns)
