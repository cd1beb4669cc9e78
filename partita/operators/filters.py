"""First-match-wins filters with a log of what was dropped and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.config import Config
from partita.functions.text import modeled_length


@dataclass(frozen=True)
class Rule:
    """Rows for which ``fails`` is true go, for ``reason``, with ``value`` as evidence. Null never fails."""

    reason: str
    fails: Column
    value: Column | None = None


def with_drop_reason(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``drop_reason`` and ``drop_value`` of the first rule that a row fails; null for rows that pass."""
    reason, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for rule in reversed(rules):
        fails = F.coalesce(rule.fails, F.lit(False))
        reason = F.when(fails, F.lit(rule.reason)).otherwise(reason)
        value = F.when(fails, rule.value.cast("double") if rule.value is not None else F.lit(None).cast("double")).otherwise(value)
    return df.withColumn("drop_reason", reason).withColumn("drop_value", value)


def split_by_rules(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)``; both are one plan over one scan each."""
    judged = with_drop_reason(df, rules)
    return judged.where("drop_reason is null").drop("drop_reason", "drop_value"), judged.where("drop_reason is not null")


def drop_histogram(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy(F.col("drop_reason").alias("reason")).agg(F.count("*").alias("n"))


def is_protein(entity: Column) -> Column:
    return F.upper(entity["polymer_type"]).contains("PROTEIN")


def is_nucleic(entity: Column) -> Column:
    return F.upper(entity["polymer_type"]).rlike("DNA|RNA|HYBRID")


def resolution_cap(cfg: Config, methods: Column) -> Column:
    """The loosest cap among an entry's enabled methods; the general one if it has none."""
    caps = F.create_map(*[F.lit(x) for m in cfg.experimental_methods for x in (m, float(cfg.resolution_cap(m)))])
    own = F.filter(methods, lambda m: m.isin(list(cfg.experimental_methods)))
    return F.coalesce(F.array_max(F.transform(own, lambda m: F.element_at(caps, m))), F.lit(float(cfg.resolution_max_A)))


def residue_count(cfg: Config) -> Column:
    """Of the first assembly whose id ends in ``-1``, else the first; else what was deposited."""
    if not cfg.use_biological_assembly:
        return F.col("deposited_residues")
    ids = F.array_sort(F.map_keys("assemblies"))
    first = F.coalesce(F.get(F.filter(ids, lambda x: x.endswith("-1")), F.lit(0)), F.get(ids, F.lit(0)))
    return F.coalesce(F.when(first.isNotNull(), F.try_element_at("assemblies", first)), F.col("deposited_residues"))


QUALITY_CAPS = (
    ("max_clashscore", "clashscore", "clashscore_too_high"),
    ("max_rfree", "rfree", "rfree_too_high"),
    ("max_ramachandran_outlier_pct", "ramachandran_outlier_pct", "ramachandran_outliers_too_high"),
    ("max_rotamer_outlier_pct", "rotamer_outlier_pct", "rotamer_outliers_too_high"),
    ("max_rsrz_outlier_pct", "rsrz_outlier_pct", "rsrz_outliers_too_high"),
)
QUALITY_FIELDS = ("clashscore", "ramachandran_outlier_pct", "rotamer_outlier_pct", "rfree", "rsrz_outlier_pct", "em_backbone_inclusion")


def has_report(quality: Column) -> Column:
    return F.coalesce(*[quality[f] for f in QUALITY_FIELDS]).isNotNull()


def entry_rules(cfg: Config) -> list[Rule]:
    """The rules of a build over the entry schema, in the order that decides the reason."""
    proteins = F.filter("polymer_entities", is_protein)
    best = F.coalesce(F.array_max(F.transform(proteins, lambda e: modeled_length(e["seq"], both_cases=True))), F.lit(0))
    quality, size, found = F.col("quality"), residue_count(cfg), F.col("resolution_A")
    rules = [Rule("no_protein_entity", F.coalesce(F.size(proteins), F.lit(0)) == 0)]
    if cfg.single_chain_only:
        rules.append(Rule("not_single_chain", F.size("polymer_entities") != 1))
    rules.append(Rule("no_protein_sequence", best == 0))
    if cfg.min_modeled_residues:
        rules.append(Rule("sequence_too_short", best < cfg.min_modeled_residues, best))
    rules += [Rule("too_large", size > cfg.max_total_residues, size), Rule("resolution_too_low", found > resolution_cap(cfg, F.col("methods")), found)]
    if cfg.require_validation_report:
        rules.append(Rule("no_validation_report", ~has_report(quality), F.lit(0.0)))
    rules += [Rule(reason, quality[name] > getattr(cfg, cap), quality[name]) for cap, name, reason in QUALITY_CAPS if getattr(cfg, cap) is not None]
    if cfg.min_em_backbone_inclusion is not None:
        inclusion = quality["em_backbone_inclusion"]
        rules.append(Rule("em_backbone_inclusion_too_low", inclusion < cfg.min_em_backbone_inclusion, inclusion))
    return rules


def filter_entries(entries: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    return split_by_rules(entries, entry_rules(cfg))
