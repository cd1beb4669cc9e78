"""Validated settings of a partition build, their canonical form and their hash."""

from __future__ import annotations

import dataclasses
import datetime
import hashlib
import json
import warnings
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

SPLITS = ("train", "val", "test")
STRUCTURAL = ("cath", "ecod", "scop2")
DOMAINS = ("pfam", "interpro")
AUTHORITIES = STRUCTURAL + DOMAINS
STRATEGIES = ("hash", "balanced", "maximal")
IDENTITY_LEVELS = (30, 50, 70, 90, 95, 100)
#: Under "balanced" a component with more than this share of all entries goes to train.
DOMINANT_SHARE = 0.002


@dataclass(frozen=True)
class Fractions:
    train: float = 0.8
    val: float = 0.1
    test: float = 0.1

    def __post_init__(self) -> None:
        if min(self.train, self.val, self.test) < 0 or abs(self.train + self.val + self.test - 1.0) > 1e-9:
            raise ValueError(f"fractions must be positive and sum to 1, not {self}")


@dataclass(frozen=True)
class Config:
    """Every setting that a build depends on; unknown names are refused by :func:`from_dict`."""

    snapshot_date: datetime.date
    experimental_methods: tuple[str, ...]
    resolution_max_A: float
    max_total_residues: int
    identity_threshold: float
    split_fractions: Fractions
    split_salt: str
    seed: int = 0
    resolution_max_A_by_method: dict[str, float] = field(default_factory=dict)
    min_modeled_residues: int = 0
    single_chain_only: bool = False
    excluded_het: tuple[str, ...] = ()
    use_biological_assembly: bool = True
    purification_metals: tuple[str, ...] = ("NI", "CO")
    histag_min_run: int = 6
    histag_terminal_min_run: int = 3
    exclude_purification_artifacts: bool = True
    clustering_backend: str = "precomputed"
    structural_clustering: str = "all"
    fold_benchmark_method: str = "off"
    split_strategy: str = "maximal"
    test_min_per_class: dict[str, int] = field(default_factory=dict)
    max_clashscore: float | None = None
    max_rfree: float | None = None
    max_ramachandran_outlier_pct: float | None = None
    max_rotamer_outlier_pct: float | None = None
    max_rsrz_outlier_pct: float | None = None
    min_em_backbone_inclusion: float | None = None
    require_validation_report: bool = False
    ligand_context_radius_A: float = 8.0
    max_ligand_atoms: int = 25
    spec: dict[str, Any] | None = None
    #: "blake2b" for the published buckets; "md5" stays inside the JVM.
    hash_name: str = "blake2b"

    def __post_init__(self) -> None:
        upper = lambda xs: tuple(dict.fromkeys(str(x).upper() for x in xs))
        put = lambda name, value: object.__setattr__(self, name, value)
        if isinstance(self.snapshot_date, str):
            put("snapshot_date", datetime.date.fromisoformat(self.snapshot_date))
        if isinstance(self.split_fractions, dict):
            put("split_fractions", Fractions(**self.split_fractions))
        put("experimental_methods", upper(self.experimental_methods))
        put("excluded_het", upper(self.excluded_het))
        put("purification_metals", upper(self.purification_metals))
        put("resolution_max_A_by_method", {str(k).upper(): float(v) for k, v in self.resolution_max_A_by_method.items()})
        checks = {
            "experimental_methods": len(self.experimental_methods) > 0,
            "resolution_max_A": self.resolution_max_A > 0,
            "resolution_max_A_by_method": all(v > 0 for v in self.resolution_max_A_by_method.values()) and set(self.resolution_max_A_by_method) <= set(self.experimental_methods),
            "max_total_residues": self.max_total_residues > 0,
            "min_modeled_residues": self.min_modeled_residues >= 0,
            "histag_min_run": self.histag_min_run > 0,
            "histag_terminal_min_run": self.histag_terminal_min_run >= 0,
            "identity_threshold": 0 < self.identity_threshold <= 1 and self.identity_level in IDENTITY_LEVELS,
            "clustering_backend": self.clustering_backend == "precomputed",
            "structural_clustering": self.structural_clustering in ("off", "union", "all", *AUTHORITIES),
            "fold_benchmark_method": self.fold_benchmark_method in ("off", *AUTHORITIES),
            "split_strategy": self.split_strategy in STRATEGIES,
            "split_salt": bool(self.split_salt),
            "seed": self.seed >= 0,
            "test_min_per_class": all(v >= 0 for v in self.test_min_per_class.values()) and set(self.test_min_per_class) <= {"metal", "nucleic_acid", "small_molecule"},
            "ligand_context_radius_A": self.ligand_context_radius_A > 0,
            "max_ligand_atoms": self.max_ligand_atoms > 0,
            "hash_name": self.hash_name in ("blake2b", "md5"),
        }
        checks |= {k: getattr(self, k) is None or getattr(self, k) > 0 for k in ("max_clashscore", "max_rfree", "min_em_backbone_inclusion")}
        checks |= {k: getattr(self, k) is None or getattr(self, k) >= 0 for k in ("max_ramachandran_outlier_pct", "max_rotamer_outlier_pct", "max_rsrz_outlier_pct")}
        wrong = [k for k, ok in checks.items() if not ok]
        if wrong:
            raise ValueError(f"invalid settings: {', '.join(wrong)}")

    @property
    def identity_level(self) -> int:
        return round(self.identity_threshold * 100)

    @property
    def dataset_version(self) -> str:
        return self.snapshot_date.strftime("%Y.%m.%d")

    def resolution_cap(self, method: str) -> float:
        return self.resolution_max_A_by_method.get(method, self.resolution_max_A)

    @property
    def loosest_resolution(self) -> float:
        """The cap that the scan may push down; the exact one is checked again by the filter."""
        return max(map(self.resolution_cap, self.experimental_methods))

    @property
    def merge_authorities(self) -> tuple[str, ...]:
        return {"off": (), "union": STRUCTURAL, "all": AUTHORITIES}.get(self.structural_clustering, (self.structural_clustering,))

    def canonical(self) -> dict[str, Any]:
        """What decides the output: no description, no export switch that is off."""
        out = json.loads(json.dumps(dataclasses.asdict(self), default=str))
        out.pop("spec")
        if self.fold_benchmark_method == "off":
            out.pop("fold_benchmark_method")
        return out

    def config_hash(self) -> str:
        return hashlib.blake2b(canonical_json(self.canonical()).encode(), digest_size=16).hexdigest()

    def tautological(self) -> bool:
        """Whether the benchmark would measure the merge itself."""
        return self.fold_benchmark_method != "off" and self.fold_benchmark_method in self.merge_authorities

    def to_spec(self, **about: str) -> dict[str, Any]:
        """A document to share: the settings under a header that states the hash they must have."""
        return {"spec": {**(self.spec or {}), **about, "expected_config_hash": self.config_hash()}, **self.canonical()}


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def from_dict(raw: dict[str, Any]) -> Config:
    if not isinstance(raw, dict):
        raise ValueError(f"settings must be a mapping, not {type(raw).__name__}")
    unknown = set(raw) - {f.name for f in dataclasses.fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = Config(**raw)
    expected = (out.spec or {}).get("expected_config_hash")
    if expected and expected != out.config_hash():
        warnings.warn(f"the settings were stamped as {expected} but hash to {out.config_hash()}", stacklevel=2)
    if out.tautological():
        warnings.warn("the benchmark authority is merged on, so every held-out family is novel by construction", stacklevel=2)
    return out


def load_config(path: str | Path) -> Config:
    """Settings from a JSON file, or a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML reader; JSON works without") from e
        return from_dict(yaml.safe_load(text))
    return from_dict(json.loads(text))


def widening(locked: Config, wanted: Config) -> list[str]:
    """Settings under which an offline rebuild would lack rows that a fresh scan would have."""
    out = []
    if wanted.snapshot_date > locked.snapshot_date:
        out.append("snapshot_date")
    if set(wanted.experimental_methods) - set(locked.experimental_methods):
        out.append("experimental_methods")
    if wanted.loosest_resolution > locked.loosest_resolution:
        out.append("resolution_max_A")
    return out
