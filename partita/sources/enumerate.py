"""Enumeration of a snapshot: page through a search, fetch records in batches, parse and write them."""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.config import Config
from partita.session import shared_dir, stage_table
from partita.sources.entries import RAW_SCHEMA, content_fingerprint, parse_raw, read_entries_jsonl, write_entries_jsonl
from partita.sources.fetch import TransportError, fetch_records, with_retries

#: Ids that a page of the search has, and that the driver holds at once.
PAGE = 10_000
# Methods whose entries have no resolution, so that a cap leaves none of them.
WITHOUT_RESOLUTION = ("SOLUTION NMR", "SOLID-STATE NMR")

#: A search takes the settings, a start and a number of rows and returns that many ids at most, in order.
Search = Callable[[Config, int, int], list[str]]


def search_pages(cfg: Config, search: Search, limit: int | None = None, page: int = PAGE) -> Iterator[list[str]]:
    """Pages of ids until one is short, each asked again while it may come; ``limit`` ids at most."""
    start = 0
    while limit is None or start < limit:
        rows = page if limit is None else min(page, limit - start)
        got = with_retries(lambda start=start, rows=rows: search(cfg, start, rows))
        if got:
            yield got
        start += len(got)
        if len(got) < rows:
            return


def search_ids(spark: SparkSession, cfg: Config, search: Search, limit: int | None = None, page: int = PAGE) -> DataFrame:
    """``(entry_id)`` of all pages, written page by page to the shared folder."""
    path = f"{shared_dir(spark)}/partita/{uuid.uuid4().hex}/ids"
    spark.createDataFrame([], "entry_id string").write.parquet(path)
    for ids in search_pages(cfg, search, limit, page):
        spark.createDataFrame([(x,) for x in ids], "entry_id string").write.mode("append").parquet(path)
    return spark.read.schema("entry_id string").parquet(path).distinct()


def records_of(body: str, asked: list[str]) -> list[str | None]:
    """JSON text of each record in an answer ``{"data": {"entries": [...]}}``; an answer that says errors and has no data is one."""
    answer = json.loads(body)
    entries = (answer.get("data") or {}).get("entries")
    if entries is None:
        raise TransportError(f"no data for {len(asked)} ids: {answer.get('errors')}", 502)
    return [None if x is None else json.dumps(x) for x in entries]


def enumerate_entries(spark: SparkSession, cfg: Config, search: Search, ask: Callable[[list[str]], str], out: str, limit: int | None = None, page: int = PAGE, batch: int = 200) -> dict:
    """Write the snapshot's entries as canonical JSON lines to ``out``; ``{"found", "count", "sha256"}`` of what is there.

    ``search`` runs on the driver, ``ask`` (ids to the text of an answer) in the
    tasks. Ids without a record are left out.
    """
    barren = sorted(set(cfg.experimental_methods) & set(WITHOUT_RESOLUTION))
    if barren:
        warnings.warn(f"{', '.join(barren)} have no resolution: the cap leaves none of their entries", stacklevel=2)
    ids = search_ids(spark, cfg, search, limit, page)
    answers = stage_table(fetch_records(ids, lambda part: records_of(ask(part), part), batch), "records")
    raw = answers.select(F.from_json("value", RAW_SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    write_entries_jsonl(stage_table(parse_raw(raw), "entries"), out)
    entries = read_entries_jsonl(spark, out)
    return {"found": ids.count(), "count": entries.count(), "sha256": content_fingerprint(entries)}
