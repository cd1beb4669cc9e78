"""N-gram Jaccard join with multiple-global-order filtering.

Documents are sets of hashed word shingles; equal sets are one set from the
start (its identifier is a hash of the whole set). Two sets can reach the
similarity only if the *prefixes* of both, the first tokens under any one
global order of all tokens, share a token from which on both still have tokens
enough. Three orders are used. All of them put rare tokens first (by a
frequency class read from a sketch over all documents) and differ in how they
order tokens of one class.

1. Under the first order every prefix token is posted with the number of tokens
   from it on; a token posted by two sets or more makes a *list*. Most tokens
   are posted once and end here, and so do postings that are too far down their
   set for any partner in the list.
2. A pair that shares a list is a candidate only if its prefixes share such a
   token under the second and under the third order as well. These prefixes,
   and a bitmap that bounds the overlap, are all that is known of a set here.
3. Whole sets are fetched and compared for candidates only.

Lists of near copies hold the same sets over and over, so pairs are never
enumerated freely. Lists of a few members pair all of them; in longer ones each
member is paired with a few leaders, a linear number, and verified links are
merged to components. After that only lists that still hold several components
matter, and of those only pairs of different components. A sketch of fixed size
can't tell rare tokens from common ones once the corpus outgrows it, so where
long lists hold more sets than a block, these are posted again, among
themselves, under an order that puts the tokens of the lists found open last,
as long as that halves their number. Lists that are long even then and share
members are gathered, so that each set is looked at once however many lists it
is in, and what is left of a gathering beside its largest component is compared
block by block: each task bounds, filters and verifies the pairs of two blocks
and emits links only, one for each merge, so what comes out never exceeds the
number of sets. Short lists name the pairs that no gathering holds.

A token that many sets of one task post is dealt out by pieces, each with its
own leaders; only these meet in the token's bucket, so no task holds a list
that grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.llm.common import in_bitmap, membership_bitmap, mix64, texts
from partita.operators.graph import connected_components
from partita.session import checkpointed, shuffle_partitions, stage_table

#: Counters of the frequency sketch; its classes, one byte each, are broadcast.
SKETCH = 1 << 22
_BLOCKS = 64
_ORDERS = tuple(np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Members of a list up to which all are paired at once, members up to which pairs of components are named, and members of a block.
ALL_PAIRS, SHORT_LIST, BLOCK = 4, 16, 1024
#: Members of a list in one task beyond which they are a piece.
PIECE = 16

# --- shingles -----------------------------------------------------------------------------------

_CHUNK = 1 << 21
_BASE = 0xD6E8FEB86659FD93
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            _powers[name] = out
    return _powers["up"], _powers["down"]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(start, hash)`` of the words of lower-cased bytes: a polynomial of each word's bytes, scrambled with its length."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashed = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)
    for k in np.flatnonzero(end - start > 64):  # a polynomial modulo 2**64 is weak on very long words
        hashed[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
    return start, hashed


def shingle_sets(batch: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; no words give an empty set."""
    at = 0
    while at < len(batch):
        upto, size = at, 0
        while upto < len(batch) and (size == 0 or size + len(batch[upto]) < _CHUNK):
            size += len(batch[upto]) + 1
            upto += 1
        group = batch[at:upto]
        at = upto
        raw = b" ".join(group).translate(_ASCII_LOWER)
        start, words = word_hashes(raw)
        ends = np.cumsum([len(t) + 1 for t in group])
        bounds = np.concatenate([[0], np.searchsorted(start, ends)])
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled = mix64(rolled * _STEP + words[k : k + len(rolled)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for k in range(a, b):
                    whole = mix64(whole * _STEP + words[k : k + 1])
                yield mix64(whole + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


# --- orders and prefixes ------------------------------------------------------------------------


def need(n: int, percent: int) -> int:
    """The least number of tokens a set of n shares with any set it links to."""
    return -(-percent * n // 100)


def overlap(n, m, percent: int):
    """The least number of tokens that linked sets of n and m tokens share."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int, late: np.ndarray | None = None) -> np.ndarray:
    """The first tokens under one global order, of which a linked set must hold at least one; in that order.

    Tokens that the bitmap ``late`` names stand behind all others.
    """
    size = len(tokens) - need(len(tokens), percent) + 1
    kind = np.minimum(classes[(tokens & np.uint64(len(classes) - 1)).astype(np.int64)], 31).astype(np.uint64)
    if late is not None:
        kind |= in_bitmap(late, tokens.view(np.int64)).astype(np.uint64) << np.uint64(5)
    rank = (kind << np.uint64(58)) | (mix64(tokens ^ _ORDERS[order]) >> np.uint64(6))
    some = np.argpartition(rank, size - 1)[:size] if size < len(tokens) else np.arange(len(tokens))
    return tokens[some[np.argsort(rank[some], kind="stable")]]


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token, four bits or more of room for each; a power of two, so that bitmaps can be folded."""
    room = max(64, 1 << int(4 * len(tokens) - 1).bit_length())
    bits = np.zeros(room, bool)
    bits[((tokens >> np.uint64(30)) & np.uint64(room - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def brief(tokens: np.ndarray, classes: np.ndarray, percent: int) -> dict[str, bytes]:
    """What the filters know of a set: its prefixes under the second and third order (four bytes a token) and its bitmap."""
    second, third = ((prefix(tokens, classes, k, percent) >> np.uint64(8)).astype(np.uint32).tobytes() for k in (1, 2))
    return {"second": second, "third": third, "bits": bitmap(tokens)}


def share_prefix(x: bytes, n: int, y: bytes, m: int, percent: int) -> bool:
    """Whether two prefixes in one order share a token from which on both sets still have tokens enough for a link.

    The first token that linked sets share stands before all others they
    share, so both have at least the whole overlap from its place on.
    """
    _, at, to = np.intersect1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), return_indices=True)
    return bool(len(at)) and int(np.minimum(n - at, m - to).max()) >= overlap(n, m, percent)


def may_link(x: bytes, n: int, y: bytes, m: int, percent: int) -> bool:
    """False only if the bitmaps prove that sets of n and m tokens don't link: a bit of one alone is a token of it alone."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum())) >= overlap(n, m, percent)


def is_candidate(a: dict, n: int, b: dict, m: int, percent: int) -> bool:
    """Whether two sets that share a prefix token under the first order pass the filters of the second and third and of their bitmaps."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    return share_prefix(a["second"], n, b["second"], m, percent) and share_prefix(a["third"], n, b["third"], m, percent) and may_link(a["bits"], n, b["bits"], m, percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Verification on the whole sets."""
    return len(np.intersect1d(a, b, assume_unique=True)) >= overlap(len(a), len(b), percent)


# --- passes over the documents ------------------------------------------------------------------

_SETS = "kind int, doc_id long, n long, sid long, digest string, block int, packed binary"
#: Sets a task remembers so as not to count or post them again; beyond that it forgets, which costs work only.
_REMEMBERED = 1 << 20


class _Seen:
    def __init__(self):
        self.held: set[int] = set()

    def add(self, sid: int) -> bool:
        """Whether ``sid`` is new."""
        if sid in self.held:
            return False
        if len(self.held) >= _REMEMBERED:
            self.held.clear()
        self.held.add(sid)
        return True


def _first_pass(batches: Iterator[pa.RecordBatch], width: int, sketch: int) -> Iterator[pa.RecordBatch]:
    """Each document's set identifier and size, then this task's share of the sketch."""
    names = ["kind", "doc_id", "n", "sid", "digest", "block", "packed"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary())

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    counts = np.zeros(sketch, np.uint32)
    seen = _Seen()
    for batch in batches:
        sizes, ids, pending, held = [], [], [], 0
        for tokens in shingle_sets(texts(batch.column(1)), width):
            sid = set_id(tokens) if len(tokens) else None
            sizes.append(len(tokens))
            ids.append(sid)
            if sid is None or not seen.add(sid):
                continue
            pending.append(tokens)
            held += len(tokens)
            if held > 1_000_000:
                _count(counts, pending)
                pending, held = [], 0
        _count(counts, pending)
        n = len(sizes)
        yield rows([0] * n, batch.column(0), sizes, ids, batch.column(2), [None] * n, [None] * n)
    # What one task saw of a counter is told up to 255; more can't change a prefix's place.
    told = np.minimum(counts, 255).astype(np.uint8).reshape(_BLOCKS, -1)
    some = [k for k in range(_BLOCKS) if told[k].any()]
    m = len(some)
    yield rows([1] * m, [None] * m, [None] * m, [None] * m, [None] * m, some, [zlib.compress(told[k].tobytes(), 1) for k in some])


def _count(counts: np.ndarray, sets: list[np.ndarray]) -> None:
    if sets:
        at, n = np.unique((np.concatenate(sets) & np.uint64(len(counts) - 1)).astype(np.uint32), return_counts=True)
        counts[at] += n.astype(np.uint32)


def _classes(sketches: DataFrame, sketch: int) -> np.ndarray:
    """The logarithmic class of every counter, summed over all documents: ``sketch`` bytes on the driver."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sketch // _BLOCKS, np.int64)
        for batch in batches:
            for piece in batch.column("packed").to_pylist():
                total += np.frombuffer(zlib.decompress(piece), np.uint8)
        classes = np.floor(np.log2(total + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([classes.tobytes()], pa.binary())], ["block", "packed"])

    out = np.zeros((_BLOCKS, sketch // _BLOCKS), np.uint8)
    for row in sketches.select("block", "packed").groupBy("block").applyInArrow(add, "block int, packed binary").collect():
        out[row["block"]] = np.frombuffer(row["packed"], np.uint8)
    return out.reshape(-1)


@dataclass
class Postings:
    """Tokens posted by sets: the set, its size, how many of its tokens stand from this one on in the first order, and whether it speaks for a piece."""

    token: np.ndarray
    owner: np.ndarray
    size: np.ndarray
    reach: np.ndarray
    speaks: np.ndarray

    def __len__(self) -> int:
        return len(self.token)

    def at(self, which: np.ndarray) -> Postings:
        return Postings(self.token[which], self.owner[which], self.size[which], self.reach[which], self.speaks[which])

    def runs(self) -> np.ndarray:
        """Of postings in the order of their tokens, the number of each one's token."""
        new = np.ones(len(self), bool)
        new[1:] = self.token[1:] != self.token[:-1]
        return np.cumsum(new) - 1

    def packed(self) -> bytes:
        # Bytes of one weight together: the high ones of sizes and places are zeros, which the shuffle compresses away.
        planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T) for x in (self.size, self.size - self.reach)]
        return b"".join(x.tobytes() for x in (self.token, self.owner, *planes, self.speaks))

    @staticmethod
    def unpacked(blocks: list[bytes]) -> Postings:
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for block in blocks:
            n = len(block) // 25
            size, place = (np.ascontiguousarray(np.frombuffer(block, np.uint8, 4 * n, k * n).reshape(4, n).T).view("<u4").ravel().astype(np.int64) for k in (16, 20))
            found = np.frombuffer(block, np.uint64, n), np.frombuffer(block, np.int64, n, 8 * n), size, size - place, np.frombuffer(block, np.bool_, n, 24 * n)
            for part, x in zip(parts, found, strict=True):
                part.append(x)
        return Postings(*map(np.concatenate, parts))


def _least(run: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The place of the least ``by`` of each run."""
    order = np.lexsort((by, run))
    return order[np.concatenate([[True], run[order][1:] != run[order][:-1]])]


def _leaders(some: Postings, run: np.ndarray) -> list[np.ndarray]:
    """A few members of each run that any part of its list would choose as well, if it has them."""
    return [_least(run, mix64(some.owner.view(np.uint64) ^ _ORDERS[k])) for k in range(len(_ORDERS))]


def _dealt(some: Postings, bucket: np.ndarray, base: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cuts[k] < cuts[k + 1]:
            yield base + k, some.at(order[cuts[k] : cuts[k + 1]]).packed()


def _postings(batches: Iterator[pa.RecordBatch], width: int, percent: int, classes: np.ndarray, buckets: int, most: int, wanted: np.ndarray | None = None, late: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Prefix tokens under the first order, packed by bucket of the token, of all documents or of those that ``wanted`` names or that have no identifier.

    A token that more than ``most`` sets of this task post is a list already: its postings go
    to other buckets by the piece, and its own bucket gets the piece's leaders
    and smallest set only.
    """
    seen = _Seen()
    tokens: list[np.ndarray] = []
    owners: list[tuple[int, int]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        lengths = np.array([len(t) for t in tokens])
        size = np.repeat(np.array([n for _, n in owners], np.int64), lengths)
        place = np.arange(len(size)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        every = Postings(np.concatenate(tokens), np.repeat(np.array([s for s, _ in owners], np.int64), lengths), size, size - place, np.zeros(len(size), bool))
        order = np.argsort(every.token, kind="stable")
        run = every.at(order).runs()
        heavy = np.bincount(run)[run] > most
        others = np.ones(len(every), bool)
        others[order[heavy]] = False
        pieces, told = every.at(order[heavy]), every.at(others)
        if len(pieces):
            run = pieces.runs()
            speakers = pieces.at(np.unique(np.concatenate([*_leaders(pieces, run), _least(run, pieces.size)])))
            speakers.speaks = np.ones(len(speakers), bool)
            told = Postings(*(np.concatenate([getattr(x, f.name) for x in (told, speakers)]) for f in fields(Postings)))
            first = np.flatnonzero(np.diff(run, prepend=-1))
            other = (mix64(pieces.token[first] + pieces.owner[first].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)[run]
        else:
            other = np.empty(0, np.int64)
        own = ((told.token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        out = [(k, x) for some, bucket, base in ((told, own, 0), (pieces, other, buckets)) for k, x in _dealt(some, bucket, base, buckets)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "packed"])

    for batch in batches:
        for whole in shingle_sets(texts((batch if wanted is None else _named_by(batch, wanted)).column(1)), width):
            if not len(whole):
                continue
            sid = set_id(whole)
            if not seen.add(sid):
                continue
            tokens.append(prefix(whole, classes, 0, percent, late))
            owners.append((sid, len(whole)))
            held += len(tokens[-1])
            if held > 2_000_000:
                yield flush()
                tokens, owners, held = [], [], 0
    if tokens:
        yield flush()


_LISTS = "tok long, sid long, n long, reach long, m long, leads array<long>"


def lists_of(some: Postings, percent: int, piece: bool) -> tuple[Postings, np.ndarray, pa.ListArray]:
    """Of one bucket, the lists of two sets or more: members, length of each one's list (2**40 where it has pieces), and the members it is paired with.

    A posting with less left from its token on than a link to the smallest set
    of the list takes belongs to no pair of this list. Lists of up to ALL_PAIRS
    members pair all, longer ones each member with a few leaders.
    """
    none = some.at(np.empty(0, np.int64)), np.empty(0, np.int64), pa.array([], pa.list_(pa.int64()))
    if not len(some):
        return none
    some = some.at(np.lexsort((~some.speaks, some.owner, some.token)))
    run = some.runs()
    some = some.at(np.concatenate([[True], (run[1:] != run[:-1]) | (some.owner[1:] != some.owner[:-1])]))
    run = some.runs()
    part = piece | (np.bincount(run, some.speaks)[run] > 0)
    if not piece:
        least = np.minimum.reduceat(some.size, np.flatnonzero(np.diff(run, prepend=-1)))[run]
        near = overlap(some.size, np.maximum(least, need(some.size, percent)), percent) <= some.reach
        near &= part | (np.bincount(run, near)[run] > 1)
        some, part = some.at(near), part[near]
    if not len(some):
        return none
    run = some.runs()
    count = np.bincount(run)[run]
    ways = [lead[run] for lead in _leaders(some, run)]
    pairs = [(np.flatnonzero(count > ALL_PAIRS), way[count > ALL_PAIRS]) for way in ways]
    for step in range(1, ALL_PAIRS):
        at = np.flatnonzero((count[step:] <= ALL_PAIRS) & (run[step:] == run[:-step])) + step
        pairs.append((at, at - step))
    one, other = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    good = (some.owner[one] != some.owner[other]) & fits(some.size[one], some.reach[one], some.size[other], some.reach[other], percent)
    one, other = one[good], other[good]
    order = np.argsort(one, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(one, minlength=len(some)))])
    return some, np.where(part, 1 << 40, count), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(some.owner[other[order]]))


def fits(n, r, m, s, percent: int):
    """Whether sets of n and m tokens, with r and s of them from a shared token on, may link by that token."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(r, s) >= overlap(n, m, percent))


def _named_by(batch: pa.RecordBatch, bitmap: np.ndarray) -> pa.RecordBatch:
    """The documents that the bitmap names or that have no identifier."""
    ids = batch.column(0)
    return batch.filter(pa.array(in_bitmap(bitmap, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)))


def _held(batches: Iterator[pa.RecordBatch], width: int, bitmap: np.ndarray, say: Callable[[np.ndarray], dict], names: list[str]) -> Iterator[pa.RecordBatch]:
    """What ``say`` tells of the sets of documents that the bitmap names or that have no identifier, each set once a batch."""
    for batch in batches:
        some = _named_by(batch, bitmap)
        if not some.num_rows:
            continue
        sets = {set_id(t): t for t in shingle_sets(texts(some.column(1)), width) if len(t)}
        told = [say(t) for t in sets.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([len(t) for t in sets.values()], pa.int64()), *(pa.array([x[c] for x in told], pa.binary()) for c in names)], ["sid", "n", *names])


# --- pairs --------------------------------------------------------------------------------------


def _paired(pairs: DataFrame, told: DataFrame, names: list[str], test: Callable[[dict, int, dict, int], bool]) -> DataFrame:
    """The named pairs ``(a, b)`` that pass a test of what is told of both sets."""
    one = told.select(F.col("sid").alias("a"), F.col("n").alias("n"), F.struct(*names).alias("x"))
    other = told.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.struct(*names).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            yield batch.select([0, 1]).filter(pa.array([test(x, n, y, m) for n, x, m, y in rows], pa.bool_()))

    return pairs.join(one, "a").join(other, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")


def _named(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of short lists that are in different components, in no common gathering, and may link by the list's token."""
    for batch in batches:
        out: set[tuple[int, int]] = set()
        for members in batch.column(0).to_pylist():
            for i, p in enumerate(members):
                for q in members[:i]:
                    if p["comp"] != q["comp"] and (p["gather"] is None or p["gather"] != q["gather"]) and fits(p["n"], p["reach"], q["n"], q["reach"], percent):
                        out.add((min(p["sid"], q["sid"]), max(p["sid"], q["sid"])))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], ["a", "b"])


def block_links(sids: np.ndarray, comps: np.ndarray, sides: np.ndarray, briefs: list[dict], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, one for each merge of two.

    ``sides`` are 0 and 1 for the two blocks of a pair (all 0: one block with
    itself). A member is bounded against all others at once, by bitmaps of one
    size (those of the next larger size folded); what passes the filters of the
    second and third order is verified on the whole sets, unless a link made
    meanwhile has joined the two.
    """
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    one, other = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if not len(other):
        other = one
    out = []
    bits = [x["bits"] for x in briefs]
    width, sizes = np.array([len(b) for b in bits]), np.array([len(t) for t in sets])
    for w in np.unique(width[one]):
        mine = one[width[one] == w]
        for v in np.unique(width[other]):
            if max(v, w) > 2 * min(v, w):
                continue  # sizes that differ so much can't link
            theirs = other[width[other] == v]
            x, y = _folded(bits, mine, min(v, w)), _folded(bits, theirs, min(v, w))
            for row, k in zip(x, mine, strict=True):
                n, m = sizes[k], sizes[theirs]
                open_ = np.flatnonzero((comps[theirs] != comps[k]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
                if not len(open_):
                    continue
                only_mine = np.bitwise_count(row & ~y[open_]).sum(axis=1, dtype=np.int64)
                only_theirs = np.bitwise_count(y[open_] & ~row).sum(axis=1, dtype=np.int64)
                m = m[open_]
                shared = np.minimum(n - only_mine, m - only_theirs)
                near = shared >= overlap(n, m, percent)
                for j in theirs[open_[near][np.argsort(-shared[near], kind="stable")]].tolist():
                    a, b = root(int(comps[k])), root(int(comps[j]))
                    if a != b and is_candidate(briefs[k], int(n), briefs[j], int(sizes[j]), percent) and linked(sets[k], sets[j], percent):
                        parent[a] = b
                        out.append((int(sids[k]), int(sids[j])))
    return out


def _folded(bits: list[bytes], which: np.ndarray, width: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(bits[k] for k in which), np.uint8).reshape(len(which), -1)
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


def _gathered(long: DataFrame) -> DataFrame:
    """``(sid, comp, gather)`` of the sets in long lists: a gathering is what such lists connect."""
    least = long.groupBy("tok").agg(F.min("sid").alias("a"))
    gathers = connected_components(long.join(least, "tok").select("a", F.col("sid").alias("b")).distinct(), "a", "b")
    return gathers.select(F.col("node").alias("sid"), F.col("component").alias("gather")).join(long.select("sid", "comp").distinct(), "sid")


def _block_merges(gathered: DataFrame, briefs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links inside gatherings: what is not in the largest component, against itself and against that one, block against block."""
    sizes = gathered.groupBy("gather", "comp").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("gather").agg(F.max(F.struct("c", "comp")).alias("x"), (F.sum("c") - F.max("c")).alias("n_rest")).where("n_rest > 0")
    largest = largest.select("gather", F.col("x.comp").alias("top"), F.col("x.c").alias("n_main"), "n_rest")
    gathered = gathered.join(largest, "gather").withColumn("main", F.col("comp") == F.col("top"))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK).cast("int"), F.lit(1))
    at = F.when(F.col("main"), F.pmod(F.xxhash64("sid"), blocks("n_main"))).otherwise(F.pmod(F.xxhash64("sid"), blocks("n_rest"))).cast("int")
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    rest_blocks = F.sequence(F.lit(0), blocks("n_rest") - 1)
    against_rest = F.transform(rest_blocks, lambda x: task(0, F.least(F.col("at"), x), F.greatest(F.col("at"), x), F.col("at") != F.least(F.col("at"), x)))
    against_main = F.transform(F.sequence(F.lit(0), blocks("n_main") - 1), lambda x: task(1, F.col("at"), x, F.lit(0)))
    main_side = F.transform(rest_blocks, lambda x: task(1, x, F.col("at"), F.lit(1)))
    rows = gathered.withColumn("at", at).withColumn("t", F.explode(F.when(F.col("main"), main_side).otherwise(F.concat(against_rest, against_main))))
    sets = held.select("sid", "tokens").join(briefs.select("sid", F.struct(*_BRIEF).alias("brief")), "sid")
    rows = rows.select("gather", "t.kind", "t.i", "t.j", "t.side", "sid", "comp").join(sets, "sid")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.select(["sid", "comp", "side", "brief", "tokens"]) for b in batches]
        sid, comp, side = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in got]) for k in range(3))
        told, whole = ([x for b in got for x in b.column(k).to_pylist()] for k in (3, 4))
        found = block_links(sid, comp, side, told, [np.frombuffer(t, np.uint64) for t in whole], percent) if (side == 0).any() else []
        yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

    return rows.groupBy("gather", "kind", "i", "j").applyInArrow(run, "a long, b long")


_BRIEF = ["second", "third", "bits"]


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, digest: Column | None = None, sketch: int = SKETCH) -> DataFrame:
    """``doc_id, n_shingles, component_id, group`` for every row of ``docs``, and ``digest`` if a column is given for it.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their
    sets of ``width``-word shingles (a shorter document is one shingle); a
    component is named by its smallest doc_id. Texts that are null or have no
    words have no shingles and stand alone. A row with a null identifier links
    as any other, but names no component; a component of such rows alone has a
    null name. ``group`` numbers the components, null for empty sets. Repeated rows are equal sets, hence one component. Other columns
    are ignored; an empty table gives no rows. Sets are compared by 64-bit
    hashes of their shingles. ``sketch`` counters (a power of two) order tokens
    by frequency; their number changes costs, never results.
    """
    spark = docs.sparkSession
    shared: list[Broadcast] = []

    def share(value) -> Broadcast:
        shared.append(spark.sparkContext.broadcast(value))
        return shared[-1]

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.lit(None) if digest is None else digest).cast("string").alias("digest"))
    first = stage_table(narrow.mapInArrow(lambda batches: _first_pass(batches, width, sketch), _SETS), "sets", "kind")
    sets = first.where("kind = 0").select("doc_id", "n", "sid", "digest")
    classes = share(_classes(first.where("kind = 1"), sketch))

    tokens = sets.agg(F.sum("n")).first()[0] or 0
    buckets = int(max(shuffle_partitions(spark), tokens * (101 - percent) // 100 // 1_000_000))

    def bucket_lists(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, m, leads = lists_of(Postings.unpacked([x for b in batches for x in b.column("packed").to_pylist()]), percent, key[0].as_py() >= buckets)
        yield pa.RecordBatch.from_arrays([pa.array(some.token.view(np.int64)), pa.array(some.owner), pa.array(some.size), pa.array(some.reach), pa.array(m), leads], ["tok", "sid", "n", "reach", "m", "leads"])

    def listed(name: str, wanted: Broadcast | None = None, late: Broadcast | None = None) -> DataFrame:
        value = lambda x: None if x is None else x.value
        posted = narrow.select("doc_id", "text").mapInArrow(lambda batches: _postings(batches, width, percent, classes.value, buckets, PIECE, value(wanted), value(late)), "bucket int, packed binary")
        return stage_table(posted.groupBy("bucket").applyInArrow(bucket_lists, _LISTS), name)

    lists = listed("lists")
    by_set = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))

    def documents_of(wanted: DataFrame) -> Broadcast:
        return share(membership_bitmap(wanted.join(by_set, "sid").select("least"), "least"))

    def fetched(wanted: DataFrame, name: str, columns: list[str], say: Callable[[np.ndarray], dict]) -> DataFrame:
        """What ``say`` tells of the sets of ``wanted(sid)``, made again from their documents."""
        named = documents_of(wanted)
        found = narrow.select("doc_id", "text").mapInArrow(lambda batches: _held(batches, width, named.value, say, columns), f"sid long, n long, {', '.join(f'{c} binary' for c in columns)}")
        return stage_table(found.join(wanted, "sid").dropDuplicates(["sid"]), name)

    def whole(wanted: DataFrame) -> DataFrame:
        return fetched(wanted, "held", ["tokens"], lambda t: {"tokens": t.tobytes()})

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()

    def briefs_of(wanted: DataFrame) -> DataFrame:
        return fetched(wanted, "briefs", _BRIEF, lambda t: brief(t, classes.value, percent))

    def candidates(pairs: DataFrame, briefs: DataFrame) -> DataFrame:
        return checkpointed(_paired(pairs, briefs, _BRIEF, lambda x, n, y, m: is_candidate(x, n, y, m, percent)))

    def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
        same = lambda x, n, y, m: linked(np.frombuffer(x["tokens"], np.uint64), np.frombuffer(y["tokens"], np.uint64), percent)
        return checkpointed(_paired(pairs, held, ["tokens"], same))

    def led(lists: DataFrame) -> DataFrame:
        """Every member and its list's leaders."""
        pairs = lists.select("sid", F.explode("leads").alias("lead"))
        return pairs.select(F.least("sid", "lead").alias("a"), F.greatest("sid", "lead").alias("b")).distinct()

    def of_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs with the components ``p`` and ``q`` of their ends."""
        of = lambda end, comp: labels.select(F.col("sid").alias(end), F.col("comp").alias(comp))
        pairs = pairs.join(of("a", "p"), "a", "left").join(of("b", "q"), "b", "left")
        return pairs.select("a", "b", F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q"))

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        joined = checkpointed(connected_components(of_components(links, labels), "p", "q")).select(F.col("node").alias("comp"), "component")
        every = by_set.select("sid").join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        return checkpointed(every.join(joined, "comp", "left").select("sid", F.coalesce("component", "comp").alias("comp")))

    def still_open(lists: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """Members of the lists that still hold several components."""
        members = lists.where(F.col("m") > ALL_PAIRS).select("tok", "sid", "n", "reach").distinct().join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        open_ = members.groupBy("tok").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.count("*").alias("m")).where("low <> high")
        smallest = F.greatest(F.col("least"), -F.floor(-percent * F.col("n") / 100))
        members = members.join(open_.select("tok", "least", "m"), "tok").where((100 + percent) * F.col("reach") >= percent * (F.col("n") + smallest))
        return stage_table(members.select("tok", "sid", "n", "reach", "comp", "m"), name)

    def named_pairs(members: DataFrame, gathered: DataFrame) -> DataFrame:
        """The pairs of short lists that no gathering ``(sid, gather)`` holds."""
        short = members.where(F.col("m") <= SHORT_LIST).join(gathered, "sid", "left")
        short = short.groupBy("tok").agg(F.collect_list(F.struct("sid", "n", "reach", "comp", "gather")).alias("members")).select("members")
        return short.mapInArrow(lambda batches: _named(batches, percent), "a long, b long").distinct()

    def links_of(pairs: DataFrame) -> DataFrame:
        near = candidates(pairs, briefs_of(ends(pairs)))
        return verified(near, whole(ends(near)))

    links = links_of(checkpointed(led(lists)))
    labels = checkpointed(connected_components(links, "a", "b")).select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    members, late, before = still_open(lists, labels, "open"), None, None
    while not members.isEmpty():
        again = checkpointed(members.where(F.col("m") > SHORT_LIST).select("sid").distinct())
        count = again.count()
        if count <= BLOCK or before is not None and 2 * count > before:
            gathered = checkpointed(_gathered(members.where(F.col("m") > SHORT_LIST)))
            named = checkpointed(named_pairs(members, gathered.select("sid", "gather")))
            briefs = briefs_of(ends(named).unionByName(gathered.select("sid")).distinct())
            near = candidates(named, briefs)
            held = whole(ends(near).unionByName(gathered.select("sid")).distinct())
            labels = merged(labels, verified(near, held).unionByName(checkpointed(_block_merges(gathered, briefs, held, percent))))
            break
        # Sets in long lists once more, among themselves, with the tokens of open lists behind all others.
        found = membership_bitmap(members.select("tok").distinct(), "tok")
        late, before = found if late is None else late | found, count
        named = named_pairs(members, again.withColumn("gather", F.lit(0).cast("long")))
        lists = listed("lists", documents_of(again), share(late))
        apart = of_components(led(lists), labels).where("p <> q").select("a", "b")
        labels = merged(labels, links_of(checkpointed(named.unionByName(apart).distinct())))
        members = still_open(lists, labels, "open")

    named_by = by_set.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    smallest = named_by.groupBy("comp").agg(F.min("least").alias("component_id"))
    out = stage_table(sets.join(named_by.join(smallest, "comp").select("sid", "component_id", F.col("comp").alias("group")), "sid", "left"), "components")
    for value in shared:
        value.destroy()
    named = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), named.alias("component_id"), "group", *(["digest"] if digest is not None else []))
