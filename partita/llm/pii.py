"""Personal data by bootstrapped contextual extraction.

Seeds are the matches of strict rules for addresses, network addresses, card
and telephone numbers. Seeds and candidates are *instances*; candidates are
what could be personal data by a coarse type: groups of digits (spaces may
part them), dotted or colon-parted groups, and names joined by ``@`` or "at".
An instance's contexts are *patterns*: the word before or after it, or both,
together with the coarse type. Patterns and
instances form a bipartite graph that Spark scores in rounds: a pattern is as
reliable as the share of its occurrences that are reliable instances of one
kind, an instance as the most reliable pattern that has it. A pattern needs
several distinct seeds. In the end the patterns above a threshold mark the
remaining instances in their contexts, and those spans are added; the seeds'
own spans always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.session import checkpointed, stage_table

KINDS = ("email", "ip", "card", "phone")

# The strict rules.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
# The coarse types.
_DIGITS = frozenset("0123456789")
_GROUPS = re.compile(r"[+(]{0,2}[0-9](?:[\x20\xa0().\-/]{0,3}[0-9])+")
_DOT = r"(?:\.|\x20?[\[(](?:\.|dot)[\])]\x20?|\x20dot\x20)"
_DOTTED = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")
_COLONS = re.compile(r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}")
_AT = re.compile(r"@|\x20?[\[(]at[\])]\x20?|\x20at\x20", re.I)
_BOTH = re.compile(r"[^@]@+[^@]")
_NAME = re.compile(r"[\w.+%-]{1,64}\Z")
_HOST = re.compile(rf"[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{1,6}}", re.I)

_SPACE = re.compile(r"[\x20\x09-\x0D]")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

ROUNDS, MIN_SEEDS, THRESHOLD = 3, 3, 0.8
#: Characters on either side of an instance in which its neighbouring words are read: what a lexical context is.
CONTEXT = 60
#: Parts into which the rows of one pattern are dealt where patterns are joined.
SALT = 16


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: around each ``@`` the longest local part that the last match leaves, if a domain follows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        elif start == at or not domain:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The matches of the strict rules by kind, in code points, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


def coarse(text: str) -> str | None:
    """The coarse type of a candidate: ``email``, ``ip``, ``number`` (7 to 19 digits) or nothing."""
    if _AT.search(text):
        return "email"
    if _DOTTED.fullmatch(text) or _COLONS.fullmatch(text):
        return "ip"
    return "number" if 7 <= sum(c in _DIGITS for c in text) <= 19 and _GROUPS.fullmatch(text) else None


def fits(kind: str, text: str) -> bool:
    """Whether a candidate of type ``number`` has as many digits as a kind may have; other types fit."""
    digits = sum(c in _DIGITS for c in text)
    return 7 <= digits <= 15 if kind == "phone" else 12 <= digits <= 19 if kind == "card" else True


def contexts(text: str, start: int, end: int, what: str, reach: int = CONTEXT) -> list[str]:
    """The patterns of an instance: the words on its sides, alone and together, with its coarse type."""
    left = text[max(0, start - reach) : start].split()
    right = text[end : end + reach].split()
    before = re.sub("[0-9]+", "0", left[-1].lower()) if left else ""
    after = re.sub("[0-9]+", "0", right[0].lower()) if right else ""
    return [f"{x}\t{what}" for x, there in ((f"<{before}", left), (f">{after}", right), (f"={before} {after}", left and right)) if there]


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Maximal stretches without white space that hold a digit or ``@``; each character is looked at once or twice."""
    at = 0
    while sign := _SIGN.search(text, at):
        start = sign.start()
        while start > at and text[start - 1] not in _SPACES:
            start -= 1
        end = _SPACE.search(text, sign.end())
        at = end.start() if end else len(text)
        yield start, at


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of a coarse type, the longest first where they overlap."""
    found: list[tuple[int, int]] = []
    for m in _AT.finditer(text):
        name = _NAME.search(text, max(0, m.start() - 64), m.start())
        host = _HOST.match(text, m.end())
        if name and host:
            found.append((name.start(), host.end()))
    if any(c in text for c in _DIGITS):
        found += [m.span() for m in _DOTTED.finditer(text)] + [m.span() for m in _GROUPS.finditer(text)]
    for first, last in tokens(text):
        token = text[first:last].strip("\"'()[]{}<>,;:.!?|")
        if "@" not in token or _BOTH.search(token):
            start = text.index(token, first)
            found.append((start, start + len(token)))
    return sorted({x for x in found if coarse(text[slice(*x)])}, key=lambda x: (x[0] - x[1], x))


def instances(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str | None, int, int]]:
    """Seeds with their kind, then candidates that touch no seed and no longer candidate."""
    out: list[tuple[str | None, int, int]] = [(k, a, b) for k in KINDS for a, b in base[k]]
    taken = sorted(s for spans in base.values() for s in spans)
    latest = list(accumulate((b for _, b in taken), max))
    free = []
    for a, b in candidates(text):
        i = bisect_left(taken, (b, 0))
        if not i or latest[i - 1] <= a:
            free.append((a, b))
    kept: list[tuple[int, int]] = []
    for a, b in free:
        i = bisect_left(kept, (b, 0))
        if not i or kept[i - 1][1] <= a:
            insort(kept, (a, b))
    return out + [(None, a, b) for a, b in kept]


_ROWS = "part int, uid long, doc_id long, counts array<long>, base array<string>, seed string, span_start int, span_end int, instance long, patterns array<string>, fits array<string>"
_NAMES = ["part", "uid", "doc_id", "counts", "base", "seed", "span_start", "span_end", "instance", "patterns", "fits"]
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (part 0), and one for each of its instances (part 1)."""
    uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            uid += 1
            text = text or ""
            base = base_spans(text)
            rows.append((0, uid, doc, [len(base[k]) for k in KINDS], [f"{k}:{a}:{b}" for k in KINDS for a, b in base[k]], None, None, None, None, None, None))
            for seed, a, b in instances(text, base):
                what = coarse(text[a:b]) if seed is None else "number" if seed in ("card", "phone") else seed
                may = [k for k in (("card", "phone") if what == "number" else (what,)) if fits(k, text[a:b])]
                rows.append((1, uid, None, None, None, seed, a, b, xxhash.xxh3_64_intdigest(text[a:b].encode()) - (1 << 63), contexts(text, a, b, what), may))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(_TYPES), _TYPES, strict=True)], _NAMES)


def _by_pattern(rows: DataFrame, patterns: DataFrame, on: list[str], spread: str) -> DataFrame:
    """``rows`` joined with the fewer ``patterns``; the rows of a common pattern are dealt into SALT parts by ``spread``."""
    copies = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).join(copies, [*on, "salt"]).drop("salt")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """``(pattern, kind, score)`` from ``(pattern, instance, seed, fits, n)``, scored in rounds over the graph."""
    edges = checkpointed(edges)
    seeds = edges.where("seed is not null").select("instance", F.col("seed").alias("kind")).distinct().withColumn("s", F.lit(1.0))
    enough = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.countDistinct("instance").alias("m")).where(F.col("m") >= min_seeds).select("pattern", "kind")
    enough = checkpointed(enough)
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    total = checkpointed(total.join(enough.select("pattern").distinct(), "pattern", "left_semi"))
    graph = checkpointed(edges.groupBy("pattern", "instance", "fits").agg(F.sum("n").alias("n")).transform(lambda g: _by_pattern(g, enough, ["pattern"], "instance")).where(F.array_contains("fits", F.col("kind"))))
    known, patterns = seeds, None
    for _ in range(rounds):
        found = graph.join(known, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("s")).alias("w"))
        patterns = checkpointed(found.join(total, "pattern").select("pattern", "kind", (F.col("w") / F.col("total")).alias("score")))
        spread = _by_pattern(graph, patterns, ["pattern", "kind"], "instance").groupBy("instance", "kind").agg(F.max("score").alias("s"))
        known = checkpointed(spread.unionByName(seeds).groupBy("instance", "kind").agg(F.max("s").alias("s")))
    return patterns


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """``doc_id, counts, base, spans`` for every row of ``docs``.

    ``counts`` are the numbers of strict matches by kind, ``base`` their spans
    as ``kind:start:end``, ``spans`` those and the ones that patterns add, by
    kind, then start. Positions are code points of the whole text. A context is
    the next word on either side, read ``CONTEXT`` characters far; names and
    host labels have the 64 and 63 characters that their standards allow.
    An instance is spans of a coarse type of any length. Null texts
    are empty and have no spans. Rows that repeat an identifier are reported
    one by one; other columns are ignored; an empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = stage_table(narrow.mapInArrow(_scan, _ROWS), "scan", "part")
    own = scanned.where("part = 0").select("uid", "doc_id", "counts", "base")
    hits = scanned.where("part = 1").select("uid", "seed", "span_start", "span_end", "instance", "fits", F.explode("patterns").alias("pattern"))
    edges = hits.groupBy("pattern", "instance", "seed", "fits").agg(F.count("*").alias("n"))
    patterns = score_patterns(edges, rounds, min_seeds).where(F.col("score") >= threshold)
    best = F.max(F.struct("score", "kind")).alias("b")
    new = _by_pattern(hits.where("seed is null"), patterns, ["pattern"], "uid").where(F.array_contains("fits", F.col("kind"))).groupBy("uid", "span_start", "span_end").agg(best)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("b.kind"))
    new = new.groupBy("uid").agg(F.collect_list(F.struct(rank.alias("rank"), "span_start", "span_end")).alias("added"))
    out = own.join(new, "uid", "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    parsed = F.transform("base", lambda x: F.struct(F.array_position(names, F.split_part(x, F.lit(":"), F.lit(1))).alias("rank"), F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("span_start"), F.split_part(x, F.lit(":"), F.lit(3)).cast("int").alias("span_end")))
    every = F.array_sort(F.concat(parsed, F.coalesce("added", F.array().cast("array<struct<rank:bigint,span_start:int,span_end:int>>"))))
    spans = F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x["rank"].cast("int")), x["span_start"].cast("string"), x["span_end"].cast("string")))
    return out.select("doc_id", "counts", "base", spans.alias("spans"))
