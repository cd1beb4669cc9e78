"""Stable hashes: buckets in [0, 1), ranks, content keys and canonical JSON."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def md5_bucket(salt: str, key: Column) -> Column:
    """The first 32 bits of ``md5(salt:key)`` over 2**32, inside the JVM."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def md5_rank(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


@F.pandas_udf(StringType())
def blake2b_hex16(text: pd.Series) -> pd.Series:
    """Hex of 128 bits; apply it to distinct values only."""
    return text.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=16).hexdigest())


@F.pandas_udf(StringType())
def blake2b_hex8(text: pd.Series) -> pd.Series:
    """Hex of 64 bits; its order as text is the order of the big-endian number."""
    return text.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest())


@F.pandas_udf(StringType())
def blake2b_hex1(text: pd.Series) -> pd.Series:
    """Hex of 8 bits."""
    return text.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=1).hexdigest())


@F.pandas_udf(DoubleType())
def blake2b_unit(text: pd.Series) -> pd.Series:
    """The 64-bit digest as a big-endian number over 2**64."""
    return text.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") / 2**64)


def bucket(salt: str, key: Column, hash_name: str = "md5") -> Column:
    if hash_name == "md5":
        return md5_bucket(salt, key)
    return blake2b_unit(F.concat(F.lit(f"{salt}:"), key.cast("string")))


def rank(seed: int, key: Column, hash_name: str = "md5") -> Column:
    """A pseudo-random order of keys that only the seed decides."""
    if hash_name == "md5":
        return md5_rank(seed, key)
    return blake2b_hex8(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def content_key(prefix: str, text: Column, hash_name: str = "md5") -> Column:
    digest = F.md5(text) if hash_name == "md5" else blake2b_hex16(text)
    return F.concat(F.lit(prefix), digest)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys, compact separators and ASCII escapes."""
    return text.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")))
