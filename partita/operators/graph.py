"""Connected components: one union-find while edges are few, alternating large-star and small-star rounds beyond."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.session import checkpointed

#: Edges up to which one task joins them all (some 200 MB there at most); the distributed rounds have no bound.
SMALL_GRAPH = 500_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def forest(pairs: Iterator[tuple]) -> dict:
    """Every node of the pairs and the smallest node that it is joined with."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in pairs:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _joined(edges: DataFrame) -> DataFrame:
    """``(u, v)``: within each partition, every node with the smallest node that the partition's edges join it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, found = None, {}

        def pairs() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        found = forest(pairs())
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), kind.field(0).type), pa.array(list(found.values()), kind.field(1).type)], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` with ``m``, the smallest end among those of ``u``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, small: int = SMALL_GRAPH) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Up to ``small`` distinct edges are joined in one task. Beyond, each
    partition first reduces its edges to stars; then each round replaces a
    node's edges by edges to the smallest node it sees, so the number of rounds
    grows with the logarithm of the longest path while the number of edges
    never grows. Only ``min`` is aggregated (map-side combine); edges meet the
    minima in plain equi-joins whose large partitions adaptive execution may
    split. Rows with a null end are ignored, self loops and repeated edges are
    harmless, no edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    # Edges are kept as (larger, smaller); a self loop keeps a lone node.
    now = checkpointed(edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _signature(now)
    if seen[0] <= small:
        return _joined(now.coalesce(1)).select(F.col("u").alias("node"), F.col("v").alias("component"))
    now = checkpointed(_joined(now).distinct())
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = _with_least(both).where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = _with_least(now)
        now = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        now = checkpointed(now)
        then, seen = seen, _signature(now)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))
