"""Components of entries, by parts first: each task joins its own entries, only what several parts hold is joined across them.

Entries hold keys, which join them, and families, which join them in some
gatherings only. A part's components are named by their smallest key. As a key
and a family leave a part once for each component there, and only those that
leave several parts make edges, what is shuffled are narrow rows, and the graph
that is left is small where entries that share keys lie together. Where they
don't, it is as large as the keys are many, and right all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.operators.graph import connected_components
from partita.session import stage_table

#: Rows that a task joins at once; an entry's rows stay together.
BLOCK_ROWS = 1_000_000


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each row's place among the distinct values (-1: null), and those values."""
    found = column.combine_chunks().dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _join(parent: list[int], entry: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Join entries that share a group; every entry's root."""
    order = np.lexsort((entry, group))
    e, g = entry[order], group[order]
    near = (g[1:] == g[:-1]) & (e[1:] != e[:-1])
    for a, b in zip(e[:-1][near].tolist(), e[1:][near].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    up = np.array(parent, np.int64)
    while True:  # roots only have smaller numbers: halving ends at them
        then = up[up]
        if np.array_equal(then, up):
            return up
        up = then


def _reduced(rows: pa.Table, prefixes: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    e, entries = _codes(rows["entry_id"])
    k, keys = _codes(rows["key"])
    f, families = _codes(rows["family"])
    m, names = _codes(rows["name"])
    n, has_key, has_family = len(entries), k >= 0, f >= 0
    sorted_names = pc.array_sort_indices(names).to_numpy()
    place = np.empty(len(names) + 1, np.int64)
    place[sorted_names] = np.arange(len(names))
    place[-1] = len(names)  # no name

    def least(root: np.ndarray) -> np.ndarray:
        """Of every entry, the place of its component's smallest name."""
        out = np.full(n, len(names))
        np.minimum.at(out, root[e[has_key]], place[m[has_key]])
        return out[root]

    parent = list(range(n))
    root = _join(parent, e[has_key], k[has_key])
    roots, held = [least(root)], []
    for prefix in prefixes:
        mine = pc.starts_with(families, prefix).to_numpy(zero_copy_only=False).astype(bool) if len(families) else np.zeros(0, bool)
        of = np.zeros(len(f), bool)
        of[has_family] = mine[f[has_family]]
        roots.append(least(_join(root.tolist(), e[of], f[of])))
        some = np.zeros(n, bool)
        some[e[of]] = True
        held.append(some)
    keyed = roots[0] < len(names)  # without a key an entry is in no component

    def out(at: np.ndarray, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
        made = dict(columns)
        for s, r in enumerate(roots):
            made[f"root_{s}"] = names.take(pa.array(sorted_names[r[at]]))
        arrays = [made[c.name].cast(c.type) if c.name in made else pa.nulls(len(at), c.type) for c in schema]
        yield from pa.Table.from_arrays(arrays, schema=schema).to_batches(max_chunksize=20_000)

    at = np.flatnonzero(keyed)
    yield from out(at, entry_id=entries.take(pa.array(at)), **{f"held_{s}": pa.array(h[at]) for s, h in enumerate(held, 1)})
    first = np.full(len(keys), -1, np.int64)
    first[k[has_key]] = e[has_key]
    yield from out(first, key=keys)
    if prefixes:
        where, of = e[has_family], f[has_family]
        where, of = where[keyed[where]], of[keyed[where]]
        _, pick = np.unique(of * (len(names) + 1) + roots[0][where], return_index=True)
        yield from out(where[pick], family=families.take(pa.array(of[pick])))


def contracted(links: DataFrame, prefixes: list[str]) -> DataFrame:
    """A stage table with a row for each entry, and for each key and family of each component of a part.

    ``links`` is ``(entry_id, key, name, family)``: an entry's key (binary) with
    the name by which it counts, or a family; an entry's rows follow one
    another. ``root_0`` names the component by keys alone, ``root_s`` the one by
    keys and the families with the ``s``-th prefix; ``held_s`` says whether the
    entry has such a family.
    """
    roots = [f"root_{s}" for s in range(len(prefixes) + 1)]
    held = [f"held_{s}" for s in range(1, len(prefixes) + 1)]
    kinds = [("entry_id", pa.string()), ("key", pa.binary()), ("family", pa.string()), *((c, pa.bool_()) for c in held), *((c, pa.string()) for c in roots)]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n, enough = 0, BLOCK_ROWS
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n < enough or not batch.num_rows:
                continue
            rows = pa.Table.from_batches(waiting)
            cut = pc.index(rows["entry_id"], rows["entry_id"][-1]).as_py()
            if cut:
                yield from _reduced(rows.slice(0, cut), prefixes, schema)
            waiting, n = rows.slice(cut).to_batches(), rows.num_rows - cut
            enough = n + BLOCK_ROWS
        if n:
            yield from _reduced(pa.Table.from_batches(waiting), prefixes, schema)

    told = ", ".join(f"{c} {'binary' if c == 'key' else 'boolean' if c in held else 'string'}" for c, _ in kinds)
    return stage_table(links.select("entry_id", "key", "name", "family").mapInArrow(run, told), "contracted")


def shared_keys(rows: DataFrame) -> DataFrame:
    """The key rows whose keys several components of parts hold; a hash leaves out most others before keys are compared."""
    keyed = rows.where("key is not null").withColumn("h", F.xxhash64("key"))
    some = stage_table(keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared_hashes")
    return stage_table(keyed.join(some, "h", "left_semi").drop("h", "entry_id", "family"), "shared_keys")


def spanning(rows: DataFrame, group: str, node: str) -> DataFrame:
    """``(group, least)`` of the groups that span several nodes."""
    return rows.groupBy(group).agg(F.min(node).alias("least"), F.max(node).alias("most")).where("least <> most").select(group, "least")


def labels_across(shared: DataFrame, families: DataFrame | None, node: str) -> DataFrame:
    """A stage table ``(node, component)`` of the components of parts that keys or families join with others."""
    edges = None
    for rows, group in ((shared, "key"), (families, "family")):
        if rows is not None:
            joins = stage_table(spanning(rows, group, node), "spanning")
            found = rows.join(joins, group).select(F.col("least").alias("src"), F.col(node).alias("dst")).distinct()
            edges = found if edges is None else edges.unionByName(found)
    return stage_table(connected_components(edges), "labels")


def named(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of each node as ``name``; a node without a label is one."""
    joined = rows.join(labels.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left")
    return joined.withColumn(name, F.coalesce(name, node))
