"""Exact deduplication with a log-structured merge index.

Every task keeps a *memtable*: a map from the digest of a normalised text to
the copies seen so far, with the text itself, so that a hit inside the memtable
is verified byte for byte at once. A memtable that reaches its byte bound is
flushed as a *run*: per bucket of the digest space one block of entries sorted
by digest, and a Bloom filter.

*Compaction* merges the blocks of a bucket two by two, those of like size first,
into sorted levels. Of two levels, digests of the newer that the older's filter
doesn't hold are new and go in without a lookup; the others are searched in the
older level. A digest found there is a hit: the merged level keeps one entry for
it, with the best row of both (most code points, then smallest identifier) and
the sum of their rows, and the hit is noted. What is left is one level for each
bucket, written to the shared folder: it says which row of each text stays.

Every hit is verified: its text is fetched again and compared byte for byte with
the text of the entry it was merged into. Digests of which this fails are taken
apart again by their bytes.

A text copied a billion times costs one entry per run, not one per copy, so no
task and no shuffle partition grows with the size of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import SPACE, in_bitmap, membership_bitmap, texts
from partita.session import checkpointed, shuffle_partitions, stage_table

_RUNS = "kind int, doc_id long, sha binary, slot long, row long, bucket int, block binary"
#: Rows of the input for each bucket of the index.
BUCKET_ROWS = 500_000
_SHA = 32


# --- filters ------------------------------------------------------------------------------------


def _keys(raw: list[bytes], width: int) -> np.ndarray:
    """Digests as byte strings that numpy can sort; a last byte of 1 keeps their zeros at the end."""
    return np.array([k + b"\1" for k in raw], f"S{width + 1}")


def _probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two filter positions of each digest, taken from its own bytes."""
    raw = keys.view(np.uint8).reshape(len(keys), keys.dtype.itemsize)[:, :-1][:, :16]
    words = np.ascontiguousarray(np.pad(raw, ((0, 0), (0, 16 - raw.shape[1])))).view(np.uint64)
    mask = np.uint64(bits - 1)
    return (words[:, 0] & mask).astype(np.int64), (words[:, 1] & mask).astype(np.int64)


def _bloom(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << max(6, int(8 * max(len(keys), 1)).bit_length()), bool)
    for at in _probes(keys, len(out)):
        out[at] = True
    return out


def _maybe(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    first, second = _probes(keys, len(bloom))
    return bloom[first] & bloom[second]


# --- memtables ----------------------------------------------------------------------------------

#: Numbers of an entry: its slot, its holder's identifier and whether it has none, then of its best
#: row the code points, whether it has no identifier, the identifier and the row's number, and the count of rows.
_NUMBERS = 8


def _memtables(batches: Iterator[pa.RecordBatch], width: int, limit: int, buckets: int) -> Iterator[pa.RecordBatch]:
    row = slot = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    table: dict[bytes, list[list]] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        # One block for each bucket: entries sorted by digest, as digests, hashes of their texts, numbers, and a filter.
        by: dict[int, list] = {}
        for key in sorted(table):
            by.setdefault(int.from_bytes(key[:8].ljust(8, b"\0"), "big") * buckets >> 64, []).extend((key, x) for x in table[key])
        blocks = []
        for rows in by.values():
            keys = [k for k, _ in rows]
            numbers = np.array([x[2:] for _, x in rows], np.int64)
            bloom = np.packbits(_bloom(_keys(keys, width))).tobytes()
            blocks.append(len(rows).to_bytes(8, "little") + b"".join(keys) + b"".join(x[1] for _, x in rows) + numbers.tobytes() + bloom)
        n = len(blocks)
        return _batch([1] * n, [None] * n, [None] * n, [None] * n, [None] * n, list(by), blocks)

    for batch in batches:
        ids, found, slots, shas, numbers = batch.column(0).to_pylist(), texts(batch.column(1)), [], [], []
        for doc, text in zip(ids, found, strict=True):
            plain = text.translate(None, SPACE)
            sha = hashlib.sha256(plain).digest()
            points = len(text) if text.isascii() else len(text.decode())
            entries = table.setdefault(sha[:width], [])
            entry = next((x for x in entries if x[0] == plain), None)
            none, known = int(doc is None), doc or 0
            if entry is None:
                slot += 1
                entries.append(entry := [plain, sha, slot, known, none, points, none, known, row, 0])
                held += len(plain) + 250
            if (-points, none, known, row) < (-entry[5], *entry[6:9]):
                entry[5:9] = points, none, known, row
            if (none, known) < (entry[4], entry[3]):
                entry[3:5] = known, none
            entry[9] += 1
            slots.append(entry[2])
            shas.append(sha)
            numbers.append(row)
            row += 1
            if held > limit:
                yield flush()
                table, held = {}, 0
        n = len(ids)
        if n:
            yield _batch([0] * n, ids, shas, slots, numbers, [None] * n, [None] * n)
    if table:
        yield flush()


def _batch(kind, doc, sha, slot, row, bucket, block) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((kind, doc, sha, slot, row, bucket, block), kinds, strict=True)], ["kind", "doc_id", "sha", "slot", "row", "bucket", "block"])


# --- compaction ---------------------------------------------------------------------------------


@dataclass
class Level:
    """Entries sorted by digest, each digest once: the entry that stands for it, the entry with its best row, and its rows."""

    keys: np.ndarray
    entry: np.ndarray
    best: np.ndarray
    rows: np.ndarray
    bloom: np.ndarray


def _better(numbers: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of entries ``a`` and ``b``, those whose best row comes first."""
    out, open_ = a.copy(), np.ones(len(a), bool)
    for x, y in ((-numbers[a, 3], -numbers[b, 3]), *((numbers[a, k], numbers[b, k]) for k in (4, 5, 6))):
        out[open_ & (y < x)] = b[open_ & (y < x)]
        open_ &= x == y
    return out


def merge(older: Level, newer: Level, numbers: np.ndarray, into: np.ndarray) -> Level:
    """One level of two; ``into`` notes for each hit the entry that it is merged into."""
    asked = np.flatnonzero(_maybe(older.bloom, newer.keys))
    at = np.minimum(np.searchsorted(older.keys, newer.keys[asked]), len(older.keys) - 1)
    found = older.keys[at] == newer.keys[asked]
    asked, at = asked[found], at[found]
    into[newer.entry[asked]] = older.entry[at]
    best, rows = older.best.copy(), older.rows.copy()
    best[at] = _better(numbers, older.best[at], newer.best[asked])
    rows[at] += newer.rows[asked]
    new = np.ones(len(newer.keys), bool)
    new[asked] = False
    place = np.searchsorted(older.keys, newer.keys[new])
    keys = np.insert(older.keys, place, newer.keys[new])
    bloom = older.bloom | newer.bloom if len(older.bloom) == len(newer.bloom) >= 8 * len(keys) else _bloom(keys)
    return Level(keys, np.insert(older.entry, place, newer.entry[new]), np.insert(best, place, newer.best[new]), np.insert(rows, place, newer.rows[new]), bloom)


def compact(blocks: list[bytes], width: int) -> tuple[Level, np.ndarray, list[bytes], np.ndarray]:
    """The blocks of one bucket as one level; with the numbers and hashes of all entries and what each was merged into."""
    numbers, shas, runs, n_entries = [], [], [], 0
    for block in blocks:
        n = int.from_bytes(block[:8], "little")
        raw = np.frombuffer(block, np.uint8, n * width, 8).reshape(n, width)
        keys = np.ascontiguousarray(np.pad(raw, ((0, 0), (0, 1)), constant_values=1)).view(f"S{width + 1}").ravel()
        base = 8 + n * width
        shas += [block[base + k * _SHA : base + (k + 1) * _SHA] for k in range(n)]
        base += n * _SHA
        own = np.frombuffer(block, np.int64, n * _NUMBERS, base).reshape(n, _NUMBERS)
        bloom = np.unpackbits(np.frombuffer(block, np.uint8, offset=base + n * _NUMBERS * 8)).astype(bool)
        numbers.append(own)
        entry = np.arange(n_entries, n_entries + n)
        n_entries += n
        # Entries of one digest in one run differ in their bytes; they are runs of their own until verified.
        while len(keys):
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            runs.append(Level(keys[first], entry[first], entry[first], own[first, 7], bloom if first.all() else _bloom(keys[first])))
            keys, entry, own = keys[~first], entry[~first], own[~first]
    every = np.concatenate(numbers)
    into = np.arange(n_entries)
    levels: list[Level] = []
    for run in runs:
        levels.append(run)
        while len(levels) > 1 and len(levels[-2].keys) < 2 * len(levels[-1].keys):
            newer = levels.pop()
            levels.append(merge(levels.pop(), newer, every, into))
    while len(levels) > 1:
        newer = levels.pop()
        levels.append(merge(levels.pop(), newer, every, into))
    while (into != into[into]).any():
        into = into[into]
    return levels[0], every, shas, into


_LEVEL = "kind int, slot long, root long, doc_id long, sha binary, hit boolean, points long, keep_id long, keep_row long, n long"


def _compacted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Entries (kind 0) with what they were merged into, and the merged level (kind 1)."""
    level, numbers, shas, into = compact([x for b in batches for x in b.column("block").to_pylist()], width)
    n, m = len(numbers), len(level.keys)
    merged = np.bincount(into, minlength=n)
    ids = lambda x, none: pa.array(x, mask=none.astype(bool))
    names = [x.split()[0] for x in _LEVEL.split(", ")]
    kind = lambda k, rows: pa.array(np.full(rows, k, np.int32))
    yield pa.RecordBatch.from_arrays(
        [kind(0, n), pa.array(numbers[:, 0]), pa.array(numbers[into, 0]), ids(numbers[:, 1], numbers[:, 2]), pa.array(shas, pa.binary()), pa.array(merged[into] > 1),
         pa.array(numbers[:, 3]), ids(numbers[:, 5], numbers[:, 4]), pa.array(numbers[:, 6]), pa.array(numbers[:, 7])], names)
    best = numbers[level.best]
    yield pa.RecordBatch.from_arrays(
        [kind(1, m), pa.nulls(m, pa.int64()), pa.array(numbers[level.entry, 0]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.bool_()),
         pa.array(best[:, 3]), ids(best[:, 5], best[:, 4]), pa.array(best[:, 6]), pa.array(level.rows)], names)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, memtable_bytes: int = 48 << 20) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``digest_bytes`` shortens the index digest (the reported hash is whole); the
    result doesn't depend on it, since every hit is verified on bytes.

    Null texts count as empty, and empty texts are equal to one another. A null
    identifier sorts after all others and is kept only if nothing else is. Of
    rows that repeat one identifier and text exactly one is marked kept.
    Columns other than the two named are ignored; an empty table gives no rows.
    """
    spark, width = docs.sparkSession, digest_bytes
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = max(shuffle_partitions(spark), narrow.count() // BUCKET_ROWS)

    def memtables(batches):
        return _memtables(batches, width, memtable_bytes, buckets)

    def compacted(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compacted(batches, width)

    runs = stage_table(narrow.mapInArrow(memtables, _RUNS), "runs", "kind")
    blocks = runs.where("kind = 1").select("bucket", "block")
    index = stage_table(blocks.groupBy("bucket").applyInArrow(compacted, _LEVEL), "index", "kind")
    entries, level = index.where("kind = 0").drop("kind"), index.where("kind = 1").select("root", "keep_id", "keep_row", F.col("n").alias("group_size"))

    hits = stage_table(_fetched(narrow, entries.where("hit")), "hits")
    roots = hits.where("slot = root").select("root", F.col("plain").alias("held"))
    apart = checkpointed(hits.join(roots, "root").where("plain <> held").select("root").distinct())
    by_slot = entries.select("slot", "root").join(level, "root").select("slot", "keep_id", "keep_row", "group_size")
    if not apart.isEmpty():
        by_slot = by_slot.join(entries.join(apart, "root").select("slot"), "slot", "left_anti").unionByName(_taken_apart(entries, hits.join(apart, "root")))
    out = runs.where("kind = 0").select("doc_id", "sha", "slot", "row").join(by_slot, "slot")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _fetched(narrow: DataFrame, hits: DataFrame) -> DataFrame:
    """``slot, root, plain`` of the hits: their holders' texts, read for these documents only (a bitmap of fixed size, then an exact join)."""
    bitmap = narrow.sparkSession.sparkContext.broadcast(membership_bitmap(hits, "doc_id"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            wanted = in_bitmap(bitmap.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(wanted))
            # Rows that repeat identifier and text are one holder.
            plain = {(doc, x.translate(None, SPACE)): None for doc, x in zip(some.column(0).to_pylist(), texts(some.column(1)), strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in plain], pa.int64()), pa.array([hashlib.sha256(x).digest() for _, x in plain], pa.binary()), pa.array([x for _, x in plain], pa.binary())], ["holder", "sha", "plain"])

    read = narrow.mapInArrow(fetch, "holder long, sha binary, plain binary")
    found = hits.select("slot", "root", "doc_id", "sha").join(read, (F.col("doc_id").eqNullSafe(F.col("holder"))) & (hits["sha"] == read["sha"]))
    return found.groupBy("slot", "root").agg(F.min("plain").alias("plain"))


def _taken_apart(entries: DataFrame, open_: DataFrame) -> DataFrame:
    """``slot, keep_id, keep_row, group_size`` of entries ``(slot, root, plain)`` whose digest stands for several texts.

    Each round settles the entries that equal the first open one of their
    digest, by an equi-join; there are as many rounds as texts of one digest.
    """
    done, variant = None, 0
    while True:
        first = open_.groupBy("root").agg(F.min("slot").alias("slot"))
        first = open_.join(first, ["slot", "root"]).select("root", F.col("plain").alias("held"))
        compared = stage_table(open_.join(first, "root").select("slot", "root", "plain", (F.col("plain") == F.col("held")).alias("same")), "apart")
        settled = compared.where("same").select("slot", F.lit(variant).alias("variant"))
        done = settled if done is None else done.unionByName(settled)
        open_, variant = compared.where("not same").select("slot", "root", "plain"), variant + 1
        if open_.isEmpty():
            break
    each = entries.join(done, "slot")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("keep_id").isNull().alias("none"), "keep_id", "keep_row")).alias("best")
    groups = each.groupBy("root", "variant").agg(best, F.sum("n").alias("group_size"))
    return each.select("slot", "root", "variant").join(groups, ["root", "variant"]).select("slot", F.col("best.keep_id").alias("keep_id"), F.col("best.keep_row").alias("keep_row"), "group_size")
