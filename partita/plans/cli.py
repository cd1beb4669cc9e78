"""Command line: build, resplit, verify, stats, spec, init and fetch over a snapshot of entries."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita import __version__
from partita.config import SPLITS, load_config, widening
from partita.functions.hashing import canonical_json
from partita.plans.build import LOCK, MANIFEST, resolve_registry, run_build, summary, verify, write_build
from partita.plans.loader import Partition
from partita.plans.progress import dataset_card
from partita.plans.wizard import run_init
from partita.session import stage_table
from partita.sources.documents import read_json, write_text
from partita.sources.entries import count_entries, read_entries_jsonl, scan
from partita.sources.fetch import TransportError, estimate_bytes, fetch_files

OK, DRIFT, BAD_INPUT, NOT_IMPLEMENTED, NETWORK, REFUSED, FAILURES, LEAK, INTERRUPTED = 0, 1, 2, 3, 4, 5, 6, 7, 130


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="partita", description=__doc__)
    out.add_argument("--version", action="version", version=__version__)
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("build", "resplit"):
        p = sub.add_parser(name)
        p.add_argument("config")
        p.add_argument("entries", help="canonical JSON lines")
        p.add_argument("out")
        p.add_argument("--registry", help="a Parquet registry of an earlier build")
        p.add_argument("--fresh", action="store_true", help="don't build on an earlier registry")
        p.add_argument("--limit", type=int, help="the first entries in order")
        p.add_argument("--count", action="store_true", help="only say how many entries are selected")
    p = sub.add_parser("verify")
    p.add_argument("out")
    p.add_argument("entries")
    p = sub.add_parser("init")
    p.add_argument("template")
    p.add_argument("out")
    p = sub.add_parser("fetch")
    p.add_argument("out")
    p.add_argument("--split", choices=("train", "val", "test"))
    p.add_argument("--classes", nargs="+", help="entries with one of these classes")
    p.add_argument("--targets", nargs="+", help="entries with a conditioning target of one of these classes")
    p.add_argument("--limit", type=int, help="the first entries of each split in order")
    p.add_argument("--deposited", action="store_true", help="what was deposited in place of the assembly")
    p.add_argument("--base-url", default="https://files.rcsb.org/download", help="where the files are")
    p.add_argument("--estimate", action="store_true", help="only say how much it would be")
    p.add_argument("--yes", action="store_true", help="fetch more than a thousand files")
    for name in ("stats", "spec"):
        sub.add_parser(name).add_argument("path")
    return out


def selected(partition: Partition, split: str | None = None, classes: list[str] | None = None, targets: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``(entry_id, split, component)`` of the entries to fetch."""
    out = None
    for name in [split] if split else SPLITS:
        view = partition.split(name)
        rows = view.entries
        if classes:
            some = view.classes.where(F.arrays_overlap("classes", F.array(*map(F.lit, classes))))
            rows = rows.join(some.select("entry_id"), "entry_id", "left_semi")
        if targets:
            rows = rows.join(view.conditioning_targets(targets), "entry_id", "left_semi")
        if limit is not None:
            rows = rows.orderBy("entry_id").limit(limit)
        out = rows if out is None else out.unionByName(rows)
    return out


def run_fetch(spark: SparkSession, args: argparse.Namespace, transport, size_of=None) -> int:
    """Fetch a partition's files through ``transport(url) -> bytes`` into its folder; write index (Parquet and JSON lines) and card.

    Files that an earlier run has indexed are hashed again: those that differ are fetched anew.
    """
    root = Path(args.out)
    partition = Partition(spark, root)
    splits = stage_table(selected(partition, args.split, args.classes, args.targets, args.limit), "selected")
    if args.estimate:
        if size_of is None:
            return NOT_IMPLEMENTED
        print(estimate_bytes(splits, size_of))
        return OK
    if transport is None or not args.yes and splits.count() > 1000:
        print("no transport" if transport is None else "more than a thousand files: say --yes", file=sys.stderr)
        return REFUSED

    def put(path: str, body: bytes) -> None:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body)

    known = spark.read.parquet(str(root / "index")).select("entry_id", "path", "sha256") if (root / "index").exists() else spark.createDataFrame([], "entry_id string, path string, sha256 string")

    def intact(frames):
        for frame in frames:
            same = [(root / p).exists() and hashlib.sha256((root / p).read_bytes()).hexdigest() == h for p, h in zip(frame["path"], frame["sha256"], strict=True)]
            yield frame[same]

    there = stage_table(known.mapInPandas(intact, "entry_id string, path string, sha256 string"), "there")
    got = stage_table(fetch_files(splits, there, transport, put, args.base_url, not args.deposited), "fetched")
    every = there.unionByName(got.where("error is null").select("entry_id", "path", "sha256"))
    index = stage_table(partition.index(every), "index")
    index.write.mode("overwrite").parquet(str(root / "index"))
    write_text(root / "index.jsonl", (f"{r['line']}\n" for r in index.orderBy("split", "entry_id").select(canonical_json(F.to_json(F.struct(*index.columns), {"ignoreNullFields": "false"})).alias("line")).toLocalIterator()))
    if (root / MANIFEST).exists():
        write_text(root / "README.md", dataset_card(read_json(root / MANIFEST), {r["split"]: r["count"] for r in index.groupBy("split").count().collect()}, not args.deposited))
    failed = got.where("error is not null")
    return OK if failed.isEmpty() else NETWORK if got.where("error is null").isEmpty() else FAILURES


def main(argv: list[str] | None = None, transport=None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "init":
            run_init(Path(args.template).read_text(encoding="utf-8"), args.out)
            return OK
        if args.command == "spec":
            print(json.dumps(load_config(args.path).to_spec(), indent=2, sort_keys=True))
            return OK
        spark = SparkSession.builder.getOrCreate()
        if args.command == "stats":
            manifest, lock = read_json(Path(args.path) / MANIFEST), read_json(Path(args.path) / LOCK)
            from partita.config import from_dict

            print(summary(manifest, from_dict(lock["config"])))
            return OK
        if args.command == "fetch":
            return run_fetch(spark, args, transport)
        entries = read_entries_jsonl(spark, args.entries)
        if args.command == "verify":
            code, report = verify(entries, read_json(Path(args.out) / LOCK))
            print("\n".join(report))
            return code
        cfg = load_config(args.config)
        if args.command == "build":
            entries = scan(entries, cfg, args.limit)
        elif (Path(args.out) / LOCK).exists():
            from partita.config import from_dict

            wider = widening(from_dict(read_json(Path(args.out) / LOCK)["config"]), cfg)
            if wider:
                print(f"the snapshot lacks entries that these would select: {', '.join(wider)}", file=sys.stderr)
        if args.count:
            print(count_entries(entries, cfg))
            return OK
        path = resolve_registry(args.out, cfg, args.registry, args.fresh)
        registry = spark.read.parquet(path) if path else None
        write_build(entries, run_build(entries, cfg, registry), args.out, registry, source=args.command)
        return OK
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return BAD_INPUT
    except TransportError as e:
        print(f"network: {e}", file=sys.stderr)
        return NETWORK
    except AssertionError as e:
        print(f"leakage: {e}", file=sys.stderr)
        return LEAK
    except KeyboardInterrupt:
        return INTERRUPTED


if __name__ == "__main__":
    sys.exit(main())
