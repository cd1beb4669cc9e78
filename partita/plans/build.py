"""A build from entries to a certified partition, and its documents."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita import __version__
from partita.config import DOMINANT_SHARE, SPLITS, Config, from_dict
from partita.operators import assign, leakage
from partita.operators.clusters import Clustering, bridging_families, cluster_entries, merging_families
from partita.operators.filters import drop_histogram, filter_entries
from partita.operators.tiers import component_tiers, conditioning_targets, entry_classes, tier_histogram
from partita.session import stage_table
from partita.sources import documents as files
from partita.sources.entries import content_fingerprint

LOCK, MANIFEST, REGISTRY = "dataset.lock", "manifest.json", "splits.registry.json"


@dataclass(frozen=True)
class Build:
    cfg: Config
    kept: DataFrame
    dropped: DataFrame
    tiers: DataFrame
    classes: DataFrame
    clusters: Clustering
    assigned: DataFrame
    splits: DataFrame
    targets: DataFrame
    outcome: dict[str, Any]


def run_build(entries: DataFrame, cfg: Config, registry: DataFrame | None = None) -> Build:
    """Filter, tier, cluster, assign and check; ``registry`` is ``(raw_key, split)`` of a prior build."""
    kept, dropped = filter_entries(entries, cfg)
    kept = stage_table(kept, "kept")
    tiers = stage_table(component_tiers(kept, cfg), "tiers")
    classes = entry_classes(tiers)
    clusters = cluster_entries(kept, cfg)
    components = stage_table(clusters.components, "components")
    sized = assign.with_bucket(assign.component_sizes(components), cfg.split_salt, cfg.hash_name)
    pin = assign.pins(clusters.keys, components, registry) if registry is not None else None
    sized = sized.join(pin, "component", "left") if pin is not None else sized.withColumn("pin", F.lit(None).cast("string"))
    sized = stage_table(sized, "sized")
    outcome: dict[str, Any] = {"n_capped": 0, "gaps": {}, "shortfalls": {}, "pinned_reassignments": 0, "pinned_entries_reassigned": 0}
    if cfg.split_strategy == "balanced":
        assigned, told = assign.assign_balanced(sized, cfg.split_fractions)
        row = told.first()
        outcome |= {"n_capped": row["n_capped"], "gaps": {s: row[f"gap_{s}"] for s in ("val", "test") if row[f"gap_{s}"]}}
    elif cfg.split_strategy == "maximal":
        assigned, told = assign.assign_maximal(sized, cfg.split_fractions)
        outcome["n_capped"] = told.first()["n_capped"]
    else:
        assigned = assign.assign_hash(sized, cfg.split_fractions)
    if cfg.test_min_per_class:
        counts = components.join(classes.select("entry_id", F.explode("classes").alias("class")), "entry_id").groupBy("component", "class").agg(F.count("*").alias("n"))
        cap = DOMINANT_SHARE if cfg.split_strategy in ("balanced", "maximal") else None
        assigned, outcome["shortfalls"] = assign.enforce_minimums(assigned, sized, counts, cfg.test_min_per_class, cap)
    assigned = stage_table(assigned, "assigned")
    if registry is not None:
        row = assign.overridden_pins(assigned, clusters.keys, components, registry).first()
        outcome |= {"pinned_reassignments": row["pins"], "pinned_entries_reassigned": row["entries"]}
    outcome["growth_stable"] = cfg.split_strategy == "hash" or registry is not None and outcome["pinned_entries_reassigned"] == 0
    splits = stage_table(assign.entry_splits(components, assigned), "splits")
    leakage.assert_no_leakage(clusters.keys, splits, clusters.families)
    targets = conditioning_targets(tiers, splits, components)
    return Build(cfg, kept, dropped, tiers, classes, clusters, assigned, splits, targets, outcome)


def pair_fingerprint(rows: DataFrame, key: str, value: str) -> str | None:
    """SHA-256 over ``key<TAB>value`` lines in the order of keys, streamed; None without rows."""
    digest, any_ = hashlib.sha256(), False
    for k, v in rows.select(key, value).orderBy(key).toLocalIterator():
        digest.update(f"{k}\t{v}\n".encode())
        any_ = True
    return digest.hexdigest() if any_ else None


def build_lock(entries: DataFrame, build: Build, registry: DataFrame | None = None, limit: int | None = None, source: str = "build") -> dict[str, Any]:
    ids = [r[0] for r in entries.select("entry_id").orderBy("entry_id").toLocalIterator()]
    return {
        "lock_schema": "lock@2", "dataset_version": build.cfg.dataset_version, "engine_version": __version__, "config_hash": build.cfg.config_hash(),
        "config": build.cfg.canonical(), "source": source, "selection": {"limit": limit},
        "candidates": {"count": len(ids), "sha256": content_fingerprint(entries), "entry_ids": ids},
        "split": {"sha256": pair_fingerprint(build.splits, "entry_id", "split"), "registry_sha256": pair_fingerprint(registry, "raw_key", "split") if registry is not None else None, "strategy": build.cfg.split_strategy},
    }


def build_manifest(build: Build) -> dict[str, Any]:
    """Counts of everything, a pure function of the build; only aggregates reach the driver."""
    counts = {r["split"]: r.asDict() for r in assign.split_counts(build.splits, build.clusters.sequence_groups).collect()}
    by_class: dict[str, dict[str, dict[str, int]]] = {}
    for kind in ("classes", "ambiguous_classes"):
        rows = build.classes.select("entry_id", F.explode(kind).alias("class")).join(build.splits, "entry_id").groupBy("split", "class").count().collect()
        by_class[kind] = {s: {r["class"]: r["count"] for r in rows if r["split"] == s} for s in SPLITS}
    flags = build.clusters.flags.agg(F.count_if("bridging").alias("bridging"), F.count_if("unclustered").alias("unclustered")).first()
    out = {
        "manifest_schema": "manifest@2", "dataset_version": build.cfg.dataset_version, "config_hash": build.cfg.config_hash(), "counts": counts,
        "dropped": {r["reason"]: r["n"] for r in drop_histogram(build.dropped).collect()}, "kept": build.kept.count(),
        "classes": by_class["classes"], "ambiguous_classes": by_class["ambiguous_classes"],
        "tiers": {r["tier_reason"]: r["n"] for r in tier_histogram(build.tiers).collect()},
        "purification_artifacts": build.classes.where("purification_artifact").count(),
        "targets": {f"{r['split']}:{r['class']}:{r['tier']}": r["count"] for r in build.targets.groupBy("split", "class", "tier").count().collect()},
        "bridging_entries": flags["bridging"], "unclustered_entries": flags["unclustered"],
        "sequence_components": build.clusters.sequence_components.select("component").distinct().count(), **build.outcome,
    }
    if build.clusters.families is not None:
        out["merging_families"] = merging_families(build.clusters.families, build.clusters.sequence_components)
        out["bridging_families"] = bridging_families(build.clusters.families, build.clusters.sequence_components).count()
    if build.clusters.labels is not None:
        out["fold_benchmark"] = leakage.benchmark_summary(build.clusters.labels, build.splits).first().asDict() | {"method": build.cfg.fold_benchmark_method, "tautological_with_merge": build.cfg.tautological()}
    return out


def migration(out: str | Path, splits: DataFrame) -> dict[str, int]:
    """Entries that moved since the build that ``out`` holds, by direction, and how many both have; empty without one."""
    before = Path(out) / "entries.splits"
    if not before.exists():
        return {}
    was = splits.sparkSession.read.parquet(str(before))
    told = leakage.moved_entries(was, splits).first().asDict()
    return told | {"common": was.join(splits, "entry_id", "left_semi").count()}


def write_build(entries: DataFrame, build: Build, out: str | Path, registry: DataFrame | None = None, source: str = "build") -> dict[str, Any]:
    """Lists, tables and documents of a build; tables are Parquet, what people read is JSON. Returns the lock."""
    out = Path(out)
    moved = migration(out, build.splits)
    for split in SPLITS:
        files.write_id_list(out / f"{split}.json", build.splits.where(F.col("split") == split))
    test = build.classes.select("entry_id", F.explode("classes").alias("class")).join(build.splits.where("split = 'test'").select("entry_id"), "entry_id")
    stale = out / "test"
    for path in stale.glob("*_test.json"):
        path.unlink()
    for row in test.select("class").distinct().collect():
        files.write_id_list(stale / f"{row['class']}_test.json", test.where(F.col("class") == row["class"]))
    tables = {"entries.splits": build.splits, "entries.keys": build.clusters.keys, "entries.classes": build.classes, "entries.tiers": build.tiers, "targets": build.targets, "registry": build.assigned.withColumnRenamed("component", "raw_key"), "sequence_groups": build.clusters.sequence_groups, "dropped": build.dropped.select("entry_id", "drop_reason", "drop_value")}
    if build.clusters.labels is not None:
        tables |= {"folds": leakage.novelty(build.clusters.labels, build.splits), "fold_groups": leakage.family_groups(build.clusters.labels, build.splits)}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(str(out / name))
    build.targets.orderBy("entry_id", "class", F.coalesce("comp_id", F.lit("")), "tier").coalesce(1).write.mode("overwrite").json(str(out / "targets.jsonl"))
    files.write_json(out / MANIFEST, build_manifest(build) | ({"migration": moved} if moved else {}))
    lock = build_lock(entries, build, registry, source=source)
    files.write_json(out / LOCK, lock)
    return lock


def verify(entries: DataFrame, lock: dict[str, Any], online: bool = False) -> tuple[int, list[str]]:
    """``(exit code, report)``: 0 the build reproduces, 1 it drifted, 2 a rebuilt lock can't be verified online."""
    if online and lock["source"] == "resplit":
        return 2, ["the lock was derived offline: verify it against its own snapshot"]
    cfg = from_dict(lock["config"])
    report = []
    if content_fingerprint(entries) != lock["candidates"]["sha256"]:
        spark = entries.sparkSession
        before = spark.createDataFrame([(x,) for x in lock["candidates"]["entry_ids"]], "entry_id string")
        for row in leakage.id_drift(before, entries.select("entry_id")).groupBy("change").count().collect():
            report.append(f"{row['count']} entries {row['change']}")
        return 1, report or ["entries changed in content"]
    if lock["split"]["registry_sha256"] is not None:
        return 0, ["the snapshot is the same; the split was built on a registry and isn't certified"]
    again = pair_fingerprint(run_build(entries, cfg).splits, "entry_id", "split")
    return (0, ["certified"]) if again == lock["split"]["sha256"] else (1, ["the split differs"])


def resolve_registry(out: str | Path, cfg: Config, explicit: str | None = None, fresh: bool = False) -> str | None:
    """The registry to build on: the one named, none if asked for a fresh build, else that of an equal earlier build."""
    if explicit or fresh:
        return explicit
    lock = files.read_json(Path(out) / LOCK, default={})
    same = lock.get("config_hash") == cfg.config_hash() and cfg.split_strategy in ("balanced", "maximal")
    return str(Path(out) / "registry") if same and (Path(out) / "registry").exists() else None


def summary(manifest: dict[str, Any], cfg: Config) -> str:
    """What a build came to, for people; shares beside their targets."""
    total = max(1, sum(c["entries"] for c in manifest["counts"].values()))
    lines = [f"dataset {manifest['dataset_version']}  kept {manifest['kept']}  dropped {sum(manifest['dropped'].values())}"]
    for s in SPLITS:
        c, target = manifest["counts"][s], 100 * getattr(cfg.split_fractions, s)
        share = 100 * c["entries"] / total
        lines.append(f"{s:5} {c['entries']} entries ({share:.2f} %, {share - target:+.2f} points), {c['components']} components, {c['sequence_groups']} sequence sets")
    lines += [f"dropped {k}: {v}" for k, v in sorted(manifest["dropped"].items())]
    for kind in ("classes", "ambiguous_classes"):
        lines += [f"{kind} {s}: " + ", ".join(f"{c} {n}" for c, n in sorted(by.items())) for s, by in manifest[kind].items() if by]
    lines += [f"targets {k}: {v}" for k, v in sorted(manifest["targets"].items())]
    if manifest.get("migration"):
        lines.append("since the last build: " + ", ".join(f"{k} {v}" for k, v in sorted(manifest["migration"].items())))
    drifts = [abs(100 * manifest["counts"][s]["entries"] / total - 100 * getattr(cfg.split_fractions, s)) for s in SPLITS]
    lines.append(f"largest drift {max(drifts):.2f} points")
    return "\n".join(lines)
