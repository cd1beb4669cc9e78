"""Small entries for the tests."""

from __future__ import annotations

from partita.config import Config, Fractions
from partita.sources.entries import ENTRY_SCHEMA

QUALITY = dict(clashscore=None, ramachandran_outlier_pct=None, rotamer_outlier_pct=None, rfree=None, rsrz_outlier_pct=None, em_backbone_inclusion=None)


def chain(name, seq="ACDEFGHIKLMNPQRSTVWY", cluster=None, kind="Protein", metals=(), structural=None, domains=None):
    return dict(entity_id=name, polymer_type=kind, seq_len=len(seq), seq=seq, cluster_ids={} if cluster is None else {"30": cluster}, metal_annotations=list(metals), structural_families=structural or {}, domain_families=domains or {})


def comp(name, formula=None, kind="non-polymer"):
    return dict(comp_id=name, name=name, formula=formula, comp_type=kind)


def entry(name, chains=None, comps=(), **more):
    base = dict(
        entry_id=name, methods=["X-RAY DIFFRACTION"], resolution_A=2.0, release_date="2020-01-01", deposited_residues=100, assemblies={}, polymer_entities=chains if chains is not None else [chain(f"{name}_1")],
        nonpolymer_comps=list(comps), bound_components=[], affinity_comp_ids=[], investigated_comp_ids=[], protein_na_interface_count=0, quality=QUALITY,
    )
    return base | more


def table(spark, entries):
    return spark.createDataFrame(entries, ENTRY_SCHEMA)


def config(**more) -> Config:
    base = dict(snapshot_date="2026-05-30", experimental_methods=("X-ray diffraction", "Electron Microscopy"), resolution_max_A=3.5, max_total_residues=5999, identity_threshold=0.3, split_fractions=Fractions(0.8, 0.1, 0.1), split_salt="s", structural_clustering="off", split_strategy="hash")
    return Config(**(base | more))
