"""JSON documents, id lists and external partitions on the driver's file system, written atomically."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(path: str | Path, text: str | Iterator[str]) -> Path:
    """Whole or not at all: a file of the same folder, renamed into place. Pieces are written as they come."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.writelines([text] if isinstance(text, str) else text)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return path


def write_json(path: str | Path, value: Any, compact: bool = False) -> Path:
    shape = {"separators": (",", ":")} if compact else {"indent": 2}
    return write_text(path, json.dumps(value, sort_keys=True, **shape) + "\n")


def read_json(path: str | Path, default: Any = None) -> Any:
    """The document, or ``default`` where there is none (an error if that is None)."""
    path = Path(path)
    if not path.exists() and default is not None:
        return default
    return json.loads(path.read_text(encoding="utf-8"))


def write_id_list(path: str | Path, ids: DataFrame, column: str = "entry_id") -> Path:
    """A JSON array with one id a line, sorted, streamed."""

    def body() -> Iterator[str]:
        before = "[\n"
        for row in ids.select(column).orderBy(column).toLocalIterator():
            yield before + json.dumps(row[0])
            before = ",\n"
        yield "[]\n" if before == "[\n" else "\n]\n"

    return write_text(path, body())


def read_id_list(path: str | Path) -> list[str]:
    return read_json(path, default=[])


def read_external_split(spark: SparkSession, path: str) -> DataFrame:
    """``(entry_id, split, test_class)`` from a JSON object of entries."""
    kind = "map<string,struct<split:string,test_class:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("entry_id", "x"))
    return rows.select(F.upper("entry_id").alias("entry_id"), "x.split", "x.test_class")


def combine_lists(spark: SparkSession, lists: list[tuple[str, str, str | None]]) -> DataFrame:
    """``(entry_id, split, test_class)`` of id-list files ``(path, split, class)``; a later list overrides."""
    from partita.operators.audit import last_label

    rows = None
    for k, (path, split, label) in enumerate(lists):
        ids = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("id"))
        part = ids.select(F.upper("id").alias("entry_id"), F.struct(F.lit(split).alias("split"), F.lit(label).cast("string").alias("test_class")).alias("label"), F.lit(k).alias("k"))
        rows = part if rows is None else rows.unionByName(part)
    return last_label(rows, "entry_id", "label", "k").select("entry_id", "label.split", "label.test_class")


def read_chain_lists(spark: SparkSession, csv: str, held: dict[str, str]) -> DataFrame:
    """``(chain, cluster, split)`` from a CSV of chains and text lists of held-out cluster ids; others are train."""
    chains = spark.read.csv(csv, header=True).select(F.col("CHAINID").alias("chain"), F.col("CLUSTER").alias("cluster"))
    lists = None
    for split, path in held.items():
        part = spark.read.text(path).select(F.trim("value").alias("cluster"), F.lit(split).alias("split")).where("cluster <> ''")
        lists = part if lists is None else lists.unionByName(part)
    return chains.join(lists, "cluster", "left").select("chain", "cluster", F.coalesce("split", F.lit("train")).alias("split"))


def missing_from_cache(spark: SparkSession, ids: DataFrame, cache: str, schema: str) -> DataFrame:
    """Ids that an append-only JSON-lines cache lacks; lines that don't parse are as if they weren't there."""
    kept = spark.read.schema(schema).option("mode", "PERMISSIVE").json(cache).where("entity_id is not null")
    return ids.join(kept.select("entity_id").distinct(), "entity_id", "left_anti")


def append_to_cache(rows: DataFrame, cache: str) -> None:
    rows.write.mode("append").json(cache)
