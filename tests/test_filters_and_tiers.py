from conftest import rows
from helpers import QUALITY, chain, comp, config, entry, table

from partita.operators.filters import drop_histogram, filter_entries
from partita.operators.tiers import component_tiers, conditioning_targets, entry_classes


def reasons(spark, entries, **cfg):
    kept, dropped = filter_entries(table(spark, entries), config(**cfg))
    return {r["entry_id"]: None for r in kept.collect()} | {r["entry_id"]: (r["drop_reason"], r["drop_value"]) for r in dropped.collect()}


def test_each_rule_and_its_boundary(spark):
    entries = [
        entry("ok"), entry("dna", [chain("a", kind="DNA")]), entry("none", []), entry("unknown", [chain("a", "XXxx")]), entry("cap", assemblies={"a-1": 5999}), entry("big", assemblies={"a-2": 1, "a-1": 6000}),
        entry("deposited", deposited_residues=6000), entry("nosize", deposited_residues=None), entry("atcap", resolution_A=3.5), entry("blurred", resolution_A=3.6), entry("nores", resolution_A=None),
    ]
    got = reasons(spark, entries)
    assert {k: v[0] for k, v in got.items() if v} == {"dna": "no_protein_entity", "none": "no_protein_entity", "unknown": "no_protein_sequence", "big": "too_large", "deposited": "too_large", "blurred": "resolution_too_low"}
    assert got["big"][1] == 6000 and got["blurred"][1] == 3.6


def test_optional_rules_in_order(spark):
    q = lambda **m: QUALITY | m
    entries = [
        entry("two", [chain("a"), chain("b")]), entry("short", [chain("a", "ACDX")]), entry("noreport"), entry("clash", quality=q(clashscore=50.0, rfree=0.9)), entry("free", quality=q(clashscore=40.0, rfree=0.4)),
        entry("em", quality=q(em_backbone_inclusion=0.6)), entry("fine", quality=q(em_backbone_inclusion=0.7)),
    ]
    got = reasons(spark, entries, single_chain_only=True, min_modeled_residues=5, require_validation_report=True, max_clashscore=40.0, max_rfree=0.3, min_em_backbone_inclusion=0.7)
    assert got == {"two": ("not_single_chain", None), "short": ("sequence_too_short", 3.0), "noreport": ("no_validation_report", 0.0), "clash": ("clashscore_too_high", 50.0), "free": ("rfree_too_high", 0.4), "em": ("em_backbone_inclusion_too_low", 0.6), "fine": None}


def test_caps_by_method_and_histogram(spark):
    entries = [entry("em", methods=["ELECTRON MICROSCOPY"], resolution_A=3.2), entry("both", methods=["ELECTRON MICROSCOPY", "X-RAY DIFFRACTION"], resolution_A=3.2), entry("other", methods=["NMR"], resolution_A=3.5)]
    cfg = config(resolution_max_A_by_method={"ELECTRON MICROSCOPY": 3.0})
    kept, dropped = filter_entries(table(spark, entries), cfg)
    assert [r.entry_id for r in kept.orderBy("entry_id").collect()] == ["both", "other"]
    assert rows(drop_histogram(dropped)) == [("resolution_too_low", 1)]


def tiers(spark, comps, chains=None, cfg=None, **more):
    got = component_tiers(table(spark, [entry("E", chains, comps, **more)]), cfg or config())
    return {r["comp_id"]: (r["tier"], r["reason"], r["class"]) for r in got.collect()}


ZN, NI, HG, HEM, GOL, NAG, SO4 = comp("ZN", "Zn 2+"), comp("NI", "Ni 2+"), comp("HG", "Hg 2+"), comp("HEM", "C34 H32 Fe N4 O4"), comp("GOL", "C3 H8 O3"), comp("NAG", "C8 H15 N O6", "D-saccharide"), comp("SO4", "O4 S 2-")


def test_metal_arms(spark):
    tagged = [chain("a", "HHHHHHACDEFG")]
    assert tiers(spark, [comp("NA", "Na 1+"), comp("CL", "Cl 1-")]) == {"NA": ("artifact", "counterion", None), "CL": ("artifact", "counterion", None)}
    assert tiers(spark, [ZN], affinity_comp_ids=["ZN"])["ZN"] == ("functional", "metal_affinity", "metal")
    assert tiers(spark, [NI], [chain("a", "HHHHHHACD", metals=["NI"])])["NI"] == ("functional", "metal_annotated", "metal")
    assert tiers(spark, [ZN], investigated_comp_ids=["ZN"])["ZN"] == ("functional", "metal_investigated", "metal")
    assert tiers(spark, [HG], bound_components=["HG"])["HG"] == ("ambiguous", "phasing_metal", None)
    assert tiers(spark, [NI], tagged, bound_components=["NI"])["NI"] == ("artifact", "histag_metal", None)
    assert tiers(spark, [NI, ZN], tagged, bound_components=["NI"])["NI"] == ("functional", "metal_bound", "metal")
    assert tiers(spark, [NI], [chain("a", metals=["ZN"])], bound_components=["NI"])["NI"] == ("ambiguous", "metal_site_nonnative", None)
    assert tiers(spark, [NI], bound_components=["NI"])["NI"] == ("ambiguous", "purification_metal_uncorroborated", None)
    assert tiers(spark, [ZN])["ZN"] == ("ambiguous", "metal_unbound", None)
    assert tiers(spark, [comp("SF4", "Fe4 S4")], bound_components=["SF4"])["SF4"] == ("functional", "metal_bound", "metal")
    assert tiers(spark, [comp("ZN", None)], bound_components=["ZN"])["ZN"] == ("functional", "metal_bound", "metal")


def test_organic_arms(spark):
    assert tiers(spark, [HEM], bound_components=["HEM"])["HEM"] == ("functional", "ligand_bound", "small_molecule")
    assert tiers(spark, [SO4], affinity_comp_ids=["SO4"])["SO4"][1] == "ligand_affinity"
    assert tiers(spark, [NAG], investigated_comp_ids=["NAG"])["NAG"] == ("ambiguous", "glycan", None)
    assert tiers(spark, [SO4], investigated_comp_ids=["SO4"])["SO4"][1] == "ligand_investigated"
    assert tiers(spark, [GOL], bound_components=["GOL"])["GOL"] == ("artifact", "additive", None)
    assert tiers(spark, [HEM], cfg=config(excluded_het=("hem",)))["HEM"][1] == "additive"
    assert tiers(spark, [HEM])["HEM"] == ("ambiguous", "ligand_unbound", None)


def test_nucleic_acid_and_roll_up(spark):
    chains = [chain("a"), chain("b", "ACGT", kind="DNA")]
    assert tiers(spark, [], chains)["nucleic_acid"] == ("ambiguous", "no_protein_na_interface", None)
    entries = table(spark, [entry("E", chains, [ZN, HEM, NAG], protein_na_interface_count=2, bound_components=["ZN"])])
    t = component_tiers(entries, config())
    row = entry_classes(t).first()
    assert row["classes"] == ["metal", "nucleic_acid"] and row["ambiguous_classes"] == ["small_molecule"] and row["metals"] == ["ZN"] and row["tiers"]["NAG"]["reason"] == "glycan"
    splits = spark.createDataFrame([("E", "test", "C")], "entry_id string, split string, component string")
    got = rows(conditioning_targets(t, splits, splits).select("cluster", "class", "comp_id", "tier"))
    assert got == [("C", "metal", "ZN", "functional"), ("C", "nucleic_acid", None, "functional"), ("C", "small_molecule", "NAG", "ambiguous")]
