"""Growth: micro-batches of new entry keys, each assigned against the registry of all before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.config import Fractions
from partita.operators import assign
from partita.operators.clusters import components_of


def grow(keys: DataFrame, registry: DataFrame, fractions: Fractions, salt: str) -> DataFrame:
    """The registry ``(raw_key, split)`` after all keys so far; prior assignments pin their components."""
    components = components_of(keys)
    sized = assign.with_bucket(assign.component_sizes(components), salt).join(assign.pins(keys, components, registry), "component", "left")
    assigned = assign.assign_hash(sized, fractions)
    return keys.join(components, "entry_id").join(assigned, "component").select("raw_key", "split").distinct()


def on_batch(read_keys: Callable[[], DataFrame], append_keys: Callable[[DataFrame], None], read_registry: Callable[[], DataFrame], write_registry: Callable[[DataFrame], None], fractions: Fractions, salt: str) -> Callable[[DataFrame, int], None]:
    """A function for ``writeStream.foreachBatch``. Components may merge, so no state per key would do."""

    def run(batch: DataFrame, _: int) -> None:
        append_keys(batch.select("entry_id", "raw_key").where(F.col("raw_key").isNotNull()).distinct())
        write_registry(grow(read_keys().distinct(), read_registry(), fractions, salt))

    return run
