"""Benchmark decontamination by an FM-index for each training shard.

A shard is a run of whole documents. Its words become symbols: the words of the
test phrases, numbered, and one separator for all others. Since no window holds
a separator, stretches of symbols shorter than the shortest window are left out
of the index; that changes no answer. The index is the Burrows-Wheeler
transform of the shard's symbols with a wavelet tree for rank and suffix
positions sampled every few text positions. All windows are searched backward
together; occurrences are located by walking to sampled positions, turned into
spans of document words and merged.

The phrases are read in blocks of bounded size, each broadcast and run against
all documents. For several blocks the rows are numbered once and written, and
spans are merged by row number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from partita.llm.common import texts, with_text
from partita.session import stage_table

#: Bytes above, digits and lower-case letters stay; A-Z are lowered; all else ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WaveletTree:
    """Rank over a sequence of symbols: one bit vector for each bit of a symbol (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        now = symbols
        for b in range(bits - 1, -1, -1):
            bit = (now >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            zeros = len(now) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(at), at
        for b, ones, zeros in self.levels:
            one = (symbol >> b) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for b, ones, zeros in self.levels:
            bit = ones[at + 1] - ones[at]
            out |= bit.astype(np.int64) << b
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; the last symbol must be the smallest and stand once."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        step = np.empty(n, bool)
        step[0] = False
        step[1:] = pair[order[1:]] != pair[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """Backward search over a symbol sequence; symbols are at least 1, 0 ends the text."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        self.n, self.sample = len(text), sample
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        self.tree = WaveletTree(bwt, max(1, int(sigma).bit_length()))
        kept = order % sample == 0
        self.kept = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
        self.marked, self.positions = kept, order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of ``phrases``."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol, open_ = phrases[:, column], low < high
            if not open_.any():
                break
            some = np.flatnonzero(open_)
            s = symbol[some]
            low[some] = self.first[s] + self.tree.rank(s, low[some])
            high[some] = self.first[s] + self.tree.rank(s, high[some])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps to the left until a sampled one is met."""
        out, walked, at, left = np.empty(len(rows), np.int64), 0, rows.astype(np.int64), np.arange(len(rows))
        while len(at):
            met = self.marked[at]
            out[left[met]] = self.positions[self.kept[at[met]]] + walked
            at, left = at[~met], left[~met]
            symbol = self.tree.access(at)
            at = self.first[symbol] + self.tree.rank(symbol, at)
            walked += 1
        return out


class Phrases:
    """A block of test items: their words, numbered, and their distinct windows by length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids = [x for x, _ in items]
        self.words: dict[bytes, int] = {}
        by: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for k, (_, text) in enumerate(items):
            said = [self.words.setdefault(w, len(self.words) + 2) for w in words_of(text)]
            width = min(window, len(said))
            for i in range(len(said) - width + 1) if width else ():
                held = by.setdefault(width, {}).setdefault(tuple(said[i : i + width]), [])
                if not held or held[-1] != k:
                    held.append(k)
        self.by = {n: (np.array(list(x), np.int64).reshape(-1, n), list(x.values())) for n, x in by.items()}
        self.shortest = min(self.by, default=0)


def _search_shard(codes: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Occurrences in a shard: document, first word, width, and the items of the window."""
    whole, starts = np.concatenate(codes), np.cumsum([0, *map(len, codes)])
    # Maximal stretches of phrase words; a document's end breaks one as a separator does.
    inside = whole > 0
    breaks = np.zeros(len(whole) + 1, bool)
    breaks[starts] = True
    begin = np.flatnonzero(inside & (breaks[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (breaks[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    none = np.empty(0, np.int64)
    if not len(begin):
        return none, none, none, []
    lengths = end - begin
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]), lengths + 1) + np.arange(int((lengths + 1).sum()))
    last = np.cumsum(lengths + 1) - 1
    symbols = np.append(whole, 0)[at]
    symbols[last] = 1
    index = FMIndex(symbols, len(phrases.words) + 1)
    found: list[tuple[np.ndarray, np.ndarray, list[list[int]]]] = []
    for width, (rows, items) in phrases.by.items():
        low, high = index.search(rows)
        some = np.flatnonzero(high > low)
        count = (high - low)[some]
        if not len(some):
            continue
        suffix = np.repeat(low[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        where = at[index.locate(suffix)]
        found.append((where, np.full(len(where), width), [items[k] for k in np.repeat(some, count)]))
    if not found:
        return none, none, none, []
    where, width = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    doc = np.searchsorted(starts, where, side="right") - 1
    return doc, where - starts[doc], width, [x for f in found for x in f[2]]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
_HITS = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(_SPAN)), StructField("items", ArrayType(StringType()))])


def _shards(batches: Iterator[pa.RecordBatch], phrases: Phrases, shard_words: int) -> Iterator[pa.RecordBatch]:
    """What is found in the text, the last column, of each row; the columns before it stay."""
    codes: list[np.ndarray] = []
    pieces: list[pa.RecordBatch] = []
    size = 0

    def search() -> pa.RecordBatch:
        doc, first, width, items = _search_shard(codes, phrases)
        spans: list[list] = [[] for _ in codes]
        named: list[set] = [set() for _ in codes]
        for k in np.lexsort((first, doc)) if len(doc) else ():
            own, start = spans[doc[k]], int(first[k])
            if own and start <= own[-1]["end"]:
                own[-1]["end"] = max(own[-1]["end"], start + int(width[k]))
            else:
                own.append({"start": start, "end": start + int(width[k])})
            named[doc[k]].update(items[k])
        labels = [[phrases.ids[i] for i in x] for x in named]
        kept = [pa.concat_arrays([p.column(k) for p in pieces]) for k in range(pieces[0].num_columns)]
        found = [pa.array([len(c) for c in codes], pa.int64()), pa.array(spans, _SPANS), pa.array(labels, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*kept, *found], [*pieces[0].schema.names, *_HITS.names])

    for batch in batches:
        others, begun = batch.select(range(batch.num_columns - 1)), 0
        for k, text in enumerate(texts(batch.columns[-1])):
            said = words_of(text)
            codes.append(np.fromiter(map(phrases.words.get, said, repeat(0)), np.int64, len(said)))
            size += len(said)
            if size >= shard_words:
                pieces.append(others.slice(begun, k + 1 - begun))
                yield search()
                codes, pieces, size, begun = [], [], 0, k + 1
        if begun < batch.num_rows:
            pieces.append(others.slice(begun))
    if codes:
        yield search()


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in benchmark.orderBy("item", "text").toLocalIterator():
        block.append((row["item"], row["text"].encode()))
        size += len(block[-1][1])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    shard_words: int = 1 << 21,
    block_bytes: int = 4 << 20,
    whole_rows: bool = False,
) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items, contaminated`` for every row of ``docs``.

    ``spans`` are the merged removal spans in document words, ``items`` the
    test items that occur, sorted as strings. A document is contaminated if
    ``n_hit > 0 and 20 * n_hit >= n_words``.

    Null texts have no words. Null item ids are named ``""``; items that repeat
    count once. Rows that repeat an identifier or have none are reported one by
    one, whatever the number of blocks. Other columns are ignored; no documents give
    no rows, no items give no hits.
    """
    spark = docs.sparkSession
    given, kinds = with_text(docs, id_col, text_col, whole_rows)
    kinds = StructType([*kinds, *_HITS.fields])
    item = F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item")
    items = benchmark.select(item, F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")).distinct()
    blocks = _blocks(items, block_bytes)
    first = list(islice(blocks, 2))
    if len(first) < 2:
        shared = spark.sparkContext.broadcast(Phrases(first[0] if first else [], window))
        found = given.mapInArrow(lambda batches: _shards(batches, shared.value, shard_words), kinds)
    else:
        # Each pass must see the same row numbers; whole rows wait in the numbered table.
        numbered = stage_table(given.select(F.monotonically_increasing_id().alias("number"), "*"), "rows")
        parts = []
        for block in chain(first, blocks):
            shared = spark.sparkContext.broadcast(Phrases(block, window))
            part = numbered.select("number", "text").mapInArrow(lambda batches, shared=shared: _shards(batches, shared.value, shard_words), StructType([StructField("number", LongType()), *_HITS.fields]))
            parts.append(part.where(F.size("items") > 0) if parts else part)
        found = reduce(DataFrame.unionByName, parts).groupBy("number").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        found = numbered.drop("text").join(found.withColumn("spans", F.expr(_MERGE)), "number").drop("number")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    out = found.select(*[f.name for f in kinds.fields[: -len(_HITS)]], "n_words", n_hit.alias("n_hit"), "spans", F.array_sort(F.array_distinct("items")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


#: Overlapping or touching spans of a sorted array become one.
_MERGE = """
aggregate(array_sort(spans), cast(array() as array<struct<start:int,end:int>>), (a, x) ->
  if(size(a) > 0 and element_at(a, -1).end >= x.start,
     concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
     concat(a, array(x))))
"""
