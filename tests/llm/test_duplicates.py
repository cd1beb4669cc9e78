import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm.data import AWKWARD, collected, docs

from partita.llm import exact_dedup as exact
from partita.llm import ngram_join
from partita.llm.exact_dedup import exact_dedup
from partita.llm.ngram_join import bitmap, block_links, brief, is_candidate, linked, may_link, ngram_components, shingle_sets


def exact_by_hand(rows):
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows]
    out, seen = [], set()
    for (doc, *_), p in zip(rows, plain, strict=True):
        same = [(-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]) for r, q in zip(rows, plain, strict=True) if p == q]
        keep = min(same, key=lambda x: x[:3])[3]
        kept = doc == keep and (doc, p) not in seen
        seen.add((doc, p))
        out.append((doc, keep, len(same), kept, hashlib.sha256(p.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest_bytes", [32, 1])
@pytest.mark.parametrize("memtable", [48 << 20, 300])
def test_exact_dedup_on_awkward_rows(spark, digest_bytes, memtable):
    got = collected(exact_dedup(docs(spark), digest_bytes=digest_bytes, memtable_bytes=memtable))
    assert got == exact_by_hand(AWKWARD)


def test_exact_dedup_with_colliding_digests_and_many_runs(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) + " " * rng.randrange(3), "s", "x") for k in range(400)]
    got = collected(exact_dedup(docs(spark, rows).repartition(6), digest_bytes=1, memtable_bytes=2000))
    assert got == exact_by_hand(rows)
    assert sum(r[3] for r in got) == len({re.sub(r"\s", "", t) for _, t, *_ in rows})


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_of_rows_without_identifiers(spark):
    rows = [(None, f"{k % 7} {k % 3}", "s", "x") for k in range(60)] + [((1 << 63) - 1, "0 0", "s", "x"), (0, "1 1", "s", "x"), (0, "11 ", "s", "x"), (0, "2 2", "s", "x")]
    for digest_bytes in (32, 1):
        assert collected(exact_dedup(docs(spark, rows).repartition(5), digest_bytes=digest_bytes, memtable_bytes=700)) == exact_by_hand(rows)


@pytest.mark.parametrize("width", [32, 2])
def test_compaction(monkeypatch, width):
    """One entry for each digest with the best row of all runs, sorted; and none of it without the filters."""
    rng = random.Random(width)
    rows = [(rng.choice([None, *range(500)]), rng.choice("abc") * rng.randrange(40) + " " * rng.randrange(3)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    blocks = [x for b in exact._memtables(iter([batch]), width, 4000, 1) for x in b.column("block").to_pylist() if x]
    assert len(blocks) > 20
    level, numbers, shas, into = exact.compact(blocks, width)
    by = {}
    for k, (doc, text) in enumerate(rows):
        sha = hashlib.sha256(text.replace(" ", "").encode()).digest()
        by.setdefault(sha[:width] + b"\1", []).append((-len(text), doc is None, doc or 0, k))
    assert level.keys.tolist() == sorted(by) and level.rows.tolist() == [len(by[k]) for k in sorted(by)]
    assert [tuple(x) for x in (numbers[level.best][:, 3:7] * [-1, 1, 1, 1]).tolist()] == [min(by[k]) for k in sorted(by)]
    assert all(shas[k][:width] == shas[into[k]][:width] and into[into[k]] == into[k] for k in range(len(into))) and len(set(into.tolist())) == len(by)
    monkeypatch.setattr(exact, "_maybe", lambda bloom, keys: np.zeros(len(keys), bool))
    assert len(exact.compact(blocks, width)[0].keys) > len(by)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components_by_hand(rows, percent=80):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def test_ngram_components_on_awkward_rows(spark):
    assert collected(ngram_components(docs(spark)).drop("group")) == components_by_hand(AWKWARD)
    assert ngram_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("short, block, piece", [(16, 1024, 16), (2, 5, 3)])
def test_ngram_components_equal_brute_force(spark, monkeypatch, short, block, piece):
    """Near copies by few and many edits, a passage in many documents, short texts, null identifiers: by short lists, and by pieces and small blocks of long ones."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    rng = random.Random(short)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, passage, rows = [word() for _ in range(90)], [word() for _ in range(25)], []
    for k in range(60):
        edited = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 4, 6])):
            edited[rng.randrange(len(edited))] = word()
        rows.append((k, " ".join(edited[: rng.choice([90, 90, 88, 80])]), "s", "x"))
    rows += [(k, " ".join(passage + [word() for _ in range(rng.choice([0, 2, 4, 5, 6, 30]))]), "s", "x") for k in range(60, 110)]
    rows += [(k, " ".join(rng.choice(passage[:3]) for _ in range(rng.randrange(9))), "s", "x") for k in range(110, 130)]
    # A set without any identifier between two that reach it alone.
    lone = [word() for _ in range(100)]
    chain = [lone[4:] + [word() for _ in range(4)], lone[:96] + [word() for _ in range(4)]]
    rows += [(None, " ".join(lone), "s", "x"), *((130 + k, " ".join(w), "s", "x") for k, w in enumerate(chain)), (None, rows[3][1] + " end", "s", "x")]
    rng.shuffle(rows)
    assert collected(ngram_components(docs(spark, rows).repartition(3)).drop("group")) == components_by_hand(rows)


def test_long_lists_of_a_full_sketch_are_posted_again(spark, monkeypatch):
    # With 64 counters all tokens look equally rare, so shared passages stand in prefixes and their lists hold nearly all sets.
    pick = random.Random(5)
    passages = [" ".join(f"p{k}.{j}" for j in range(12)) for k in range(20)]
    rows = []
    for doc in range(120):
        words = [f"w{pick.randrange(10**9)}" for _ in range(150)] + pick.sample(passages, 8)
        rows.append((doc, " ".join(words), None, None))
    rows += [(1000 + doc, f"{rows[doc][1]} some more words at the end", None, None) for doc in range(0, 120, 10)]
    compared = []
    merges = ngram_join._block_merges
    monkeypatch.setattr(ngram_join, "_block_merges", lambda gathered, *rest: compared.append(gathered.count()) or merges(gathered, *rest))
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    assert collected(ngram_components(docs(spark, rows).repartition(3), sketch=64).drop("group")) == components_by_hand(rows)
    assert sum(compared) < 30


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    classes = np.zeros(ngram_join.SKETCH, np.uint8)
    passed = 0  # by the bitmaps; the filters of all three orders never rule out a link either
    for _ in range(1500):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.choice([0.05, 0.2, 0.5])], rng.integers(0, 1 << 63, rng.integers(0, 8), dtype=np.uint64)]))
        if not len(b):
            continue
        shared = len(np.intersect1d(a, b))
        truth = 100 * shared >= 80 * (len(a) + len(b) - shared)
        near = may_link(bitmap(a), len(a), bitmap(b), len(b), 80)
        assert near or not truth
        assert linked(a, b, 80) == truth
        x, y = brief(a, classes, 80), brief(b, classes, 80)
        assert is_candidate(x, len(a), y, len(b), 80) or not truth
        first = ngram_join.prefix(a, classes, 0, 80), ngram_join.prefix(b, classes, 0, 80)
        _, at, to = np.intersect1d(*first, return_indices=True)
        assert bool(ngram_join.fits(len(a), len(a) - at, len(b), len(b) - to, 80).any()) or not truth
        sids, comps = np.array([1, 2]), np.array([1, 2])
        for sides in ([0, 0], [0, 1]):
            assert bool(block_links(sids, comps, np.array(sides), [x, y], [a, b], 80)) == truth
        passed += near
    assert 100 < passed < 1400


def test_shingle_sets_tell_texts_apart():
    texts = [b"a b c d e f", b"A B C D E F", b"a b c d e g", b"", b"  ", b"a b", b"b a", b"a b c d e", b"x" * 200 + b" y", b"x" * 201 + b" y"]
    got = [tuple(s) for s in shingle_sets(texts, 5)]
    assert got[0] == got[1] and len(got[0]) == 2 and got[0] != got[2] and got[3] == got[4] == ()
    assert len({got[k] for k in (5, 6, 7, 8, 9)}) == 5 and got[7][0] in got[0]
    assert got == [tuple(next(shingle_sets([t], 5))) for t in texts]
