"""Reading a finished partition: views of its splits, targets, samples and weights."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.operators.sampling import redundancy_weights, sample_one_per_group


@dataclass(frozen=True)
class View:
    """One split: lazily restricted tables."""

    entries: DataFrame
    classes: DataFrame
    targets: DataFrame
    groups: DataFrame | None
    folds: DataFrame | None
    hash_name: str = "blake2b"

    def count(self) -> int:
        return self.entries.count()

    def with_class(self, label: str) -> DataFrame:
        return self.entries.join(self.classes.where(F.array_contains("classes", label)).select("entry_id"), "entry_id", "left_semi")

    def conditioning_targets(self, classes: list[str] | None = None, include_ambiguous: bool = False) -> DataFrame:
        out = self.targets if include_ambiguous else self.targets.where("tier = 'functional'")
        return out.where(F.col("class").isin(classes)) if classes is not None else out

    def targets_by_entry(self, **which) -> DataFrame:
        return self.conditioning_targets(**which).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("class", "comp_id", "tier", "reason"))).alias("targets"))

    def conditioned_entries(self, **which) -> DataFrame:
        return self.entries.join(self.conditioning_targets(**which), "entry_id", "left_semi")

    def novel_entries(self) -> DataFrame:
        if self.folds is None:
            raise ValueError("the partition was built without a benchmark authority")
        return self.folds.where("novel")

    def is_novel_fold(self, entry_id: str) -> bool:
        return not self.novel_entries().where(F.col("entry_id") == entry_id).isEmpty()

    def folds_of(self, entry_id: str) -> list[str]:
        """The families of an entry by the benchmark authority; none if it has none."""
        row = None if self.folds is None else self.folds.where(F.col("entry_id") == entry_id).first()
        return list(row["families"]) if row else []

    def sample_by_cluster(self, seed: int = 0) -> DataFrame:
        return sample_one_per_group(self.entries.withColumn("grp", F.coalesce("component", "entry_id")), "grp", seed, hash_name=self.hash_name)

    def sample_by_sequence(self, seed: int = 0) -> DataFrame:
        """One entry for each sequence group; all entries where the build has no groups."""
        if self.groups is None:
            return self.entries.select("entry_id")
        return sample_one_per_group(self._by_sequence(), "sequence_group", seed, hash_name=self.hash_name)

    def redundancy_weights(self) -> DataFrame:
        """One over the size of an entry's sequence group; 1.0 for all where the build has no groups."""
        if self.groups is None:
            return self.entries.select("entry_id", F.lit(1.0).alias("weight"))
        return redundancy_weights(self._by_sequence(), "sequence_group")

    def _by_sequence(self) -> DataFrame:
        return self.entries.join(self.groups, "entry_id")


class Partition:
    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.path = spark, Path(path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.path / name))

    def split(self, name: str) -> View:
        """A split by name; one that was never written is an error, not an empty view."""
        if not (self.path / f"{name}.json").exists():
            raise FileNotFoundError(f"no split {name!r} in {self.path}")
        entries = self._table("entries.splits").where(F.col("split") == name)
        within = lambda df: df.join(entries.select("entry_id"), "entry_id", "left_semi")
        folds = within(self._table("folds")) if (self.path / "folds").exists() else None
        return View(entries, within(self._table("entries.classes")), within(self._table("targets")), within(self._table("sequence_groups")) if (self.path / "sequence_groups").exists() else None, folds)

    @property
    def train(self) -> View:
        return self.split("train")

    @property
    def val(self) -> View:
        return self.split("val")

    @property
    def test(self) -> View:
        return self.split("test")

    def fold_groups(self) -> DataFrame:
        return self._table("fold_groups")

    def index(self, fetched: DataFrame) -> DataFrame:
        """``fetched(entry_id, path, sha256)`` with split, cluster, classes and targets; what is missing is empty."""
        splits = self._table("entries.splits")
        targets = self._table("targets").groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("class", "comp_id", "tier", "reason"))).alias("conditioning_targets"))
        out = fetched.join(splits, "entry_id", "left").join(self._table("entries.classes").select("entry_id", "classes", "tiers"), "entry_id", "left").join(targets, "entry_id", "left")
        none = F.array().cast("array<string>")
        return out.select("entry_id", "split", "path", "sha256", F.coalesce("component", "entry_id").alias("cluster"), F.coalesce("classes", none).alias("classes"), "tiers", "conditioning_targets").orderBy("split", "entry_id")
