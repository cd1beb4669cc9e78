"""Corpus pipeline: toxicity, exact and near duplicates, benchmark passages, source mix.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents its
predecessor kept, and drops what its operator rejects; all but the last return
the columns of ``documents``. ``run`` writes each stage as Parquet into the
shared folder and hands what it reads back to the next.

Every row is decided by itself, whether or not it has an identifier or shares
it with others: the models and the search for test passages pass whole rows
through, the duplicate stages tell rows apart by identifier and digest of the
text, nulls included. Rows equal in both are one document: one stays after exact
dedup. Columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partita.llm.common import table
from partita.llm.decontaminate import contamination
from partita.llm.exact_dedup import exact_dedup
from partita.llm.mixing import mix_sources
from partita.llm.ngram_join import ngram_components
from partita.llm.toxicity import toxicity
from partita.session import stage_table


def _identity(digest: Column) -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest)


def _those(docs: DataFrame, digest: Column, kept: DataFrame) -> DataFrame:
    """The rows ``(key, row)`` of ``docs``, as structs, whose identity is a ``key`` of ``kept``."""
    return docs.select(_identity(digest).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(kept, "key", "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (learnt from ``labels``) predicts as toxic go."""
    return toxicity(docs, table(spark, sf_dir, "labels"), whole_rows=True).where("predicted = 0").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the most code points stays, then with the smallest identifier, and of rows that repeat it one row."""
    kept = exact_dedup(docs).where("kept").select(_identity(F.col("text_sha256")).alias("key")).distinct()
    plain = F.sha2(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", ""), 256)
    order = Window.partitionBy("key").orderBy(F.length("row.text").desc_nulls_last(), F.xxhash64("row"))
    return _those(docs, plain, kept).withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: its smallest identifier, or the smallest digest where none has an identifier."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    found = ngram_components(docs, digest=digest)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best")
    first = found.where(F.col("group").isNotNull()).groupBy("group").agg(best).select("best.doc_id", "best.digest")
    kept = first.unionByName(found.where(F.col("group").isNull()).select("doc_id", "digest"))
    return _those(docs, digest, kept.select(_identity(F.col("digest")).alias("key"))).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by test passages go; all others stay as they are."""
    return contamination(docs, table(spark, sf_dir, "benchmark"), whole_rows=True).where("not contaminated").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: A trained classifier decides the first stage, which SQL can't express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
