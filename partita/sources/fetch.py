"""Batched fetching of records and files through a transport that the caller injects."""

from __future__ import annotations

import gzip
import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.functions.text import file_name, relative_path

RETRY_STATUS = (429, 500, 502, 503, 504)


class TransportError(RuntimeError):
    """What a transport raises; ``status`` is None when no answer came."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def with_retries(call: Callable, tries: int = 4, base: float = 1.5, sleep: Callable[[float], None] = time.sleep):
    """``call()`` again, after growing pauses, while what it raises may pass."""
    for k in range(tries):
        try:
            return call()
        except TransportError as e:
            if k == tries - 1 or e.status is not None and e.status not in RETRY_STATUS:
                raise
            sleep(base**k)


def fetch_records(ids: DataFrame, fetch: Callable[[list[str]], list[str | None]], batch: int = 200, column: str = "entry_id") -> DataFrame:
    """``(value)``: JSON text of each record that ``fetch`` returns for a batch of ids; nulls are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names = frame[column].tolist()
            for at in range(0, len(names), batch):
                got = with_retries(lambda part=names[at : at + batch]: fetch(part))
                yield pd.DataFrame({"value": [x for x in got if x is not None]}, dtype=object)

    return ids.select(column).mapInPandas(run, "value string")


def fetch_files(entry_split: DataFrame, there: DataFrame, get: Callable[[str], bytes], put: Callable[[str, bytes], None], base_url: str, assembly: bool = False) -> DataFrame:
    """``(entry_id, path, sha256, n_bytes, error)``: files that ``there(path)`` lacks are fetched, checked and put.

    The path follows from split and id alone, so a second run continues the
    first. A failure is a row with an error, not an exception.
    """
    wanted = entry_split.select("entry_id", relative_path(F.col("entry_id"), F.col("split"), assembly).alias("path"), F.concat_ws("/", F.lit(base_url), file_name(F.col("entry_id"), assembly)).alias("url"))
    wanted = wanted.join(there.select("path"), "path", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                try:
                    body = with_retries(lambda url=row.url: get(url))
                    gzip.decompress(body)
                    put(row.path, body)
                    out.append((row.entry_id, row.path, hashlib.sha256(body).hexdigest(), len(body), None))
                except (TransportError, OSError, EOFError) as e:
                    out.append((row.entry_id, row.path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["entry_id", "path", "sha256", "n_bytes", "error"])

    return wanted.mapInPandas(run, "entry_id string, path string, sha256 string, n_bytes long, error string")


def estimate_bytes(ids: DataFrame, size_of: Callable[[str], int | None], sample: int = 12, column: str = "entry_id") -> int:
    """The mean size of the first ids times their number."""
    first = [r[0] for r in ids.select(column).orderBy(column).limit(sample).collect()]
    sizes = [n for n in map(size_of, first) if n]
    return round(sum(sizes) / len(sizes) * ids.count()) if sizes else 0
