"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

#: The ASCII white space that the contracts name.
SPACE = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def with_text(docs: DataFrame, id_col: str, text_col: str, whole_rows: bool) -> tuple[DataFrame, list[StructField]]:
    """``docs`` as ``doc_id``, if wanted ``row`` (a struct of all columns), and ``text``; and the fields before the text."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row, F.col(text_col).cast("string").alias("text"))
    return out, out.schema.fields[:-1]


def held_out(doc_id: Column) -> Column:
    """The rows of which no model learns: crc32 of the identifier as text, modulo 5, is 0 (a null counts as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitted(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, fit: Callable[[list[bytes], list[int]], Any], rows: int, size: int) -> Any:
    """What ``fit`` makes of marked texts that aren't held out: the first ``rows`` in the order of a hash of their identifier, up to about ``size`` bytes.

    ``marks`` are ``(i, y)``, each identifier once. Documents that repeat a
    marked identifier count as rows of their own, within the same bounds. The
    sample goes to one task, which fits and returns the model alone, so the
    driver holds neither texts nor the arrays of training.
    """
    mine = marks.where("i is not null").where(~held_out(F.col("i"))).orderBy(F.xxhash64("i"), "i").limit(rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    found = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("text")).join(mine, "i")
    found = found.select(F.xxhash64("i").alias("h"), "i", "text", "y").orderBy("h", "i", "text").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        sample, said, held = [], [], 0
        for _, _, text, y in given:
            if held >= size:
                break
            held += len(text)
            sample.append(text)
            said.append(y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample, said))], pa.binary())], ["model"])

    model = found.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(model["model"]) if model else fit([], [])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of the membership bitmap; its 4 MB are all that is ever broadcast for it.
BITMAP_BITS = 1 << 25


def membership_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size that holds every value of a long column.

    Each task folds its values into one bitmap and the pieces are OR-ed block
    by block, so the driver receives ``BITMAP_BITS / 8`` bytes at any input
    size. It has false positives only: what it lets through is joined exactly.
    """
    blocks, words = 64, BITMAP_BITS // 8 // 64

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP_BITS, bool)
        for batch in batches:
            bits[bit_of(batch.column(0).drop_null().to_numpy(zero_copy_only=False))] = True
        packed = np.packbits(bits).reshape(blocks, words)
        some = [k for k in range(blocks) if packed[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[k].tobytes() for k in some], pa.binary())], ["block", "bits"])

    def merge(key: tuple, got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words, np.uint8)
        for batch in got:
            for piece in batch.column("bits").to_pylist():
                total |= np.frombuffer(piece, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "bits"])

    parts = ids.select(F.col(column).cast("long")).mapInArrow(fold, "block int, bits binary")
    out = np.zeros((blocks, words), np.uint8)
    for row in parts.groupBy("block").applyInArrow(merge, "block int, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def bit_of(values: np.ndarray) -> np.ndarray:
    return (mix64(values.astype(np.int64).view(np.uint64)) & np.uint64(BITMAP_BITS - 1)).astype(np.int64)


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = bit_of(values)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
