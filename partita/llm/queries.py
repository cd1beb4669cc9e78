"""The queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.llm.chat_format import digests, format_chats, hostile_conversation
from partita.llm.common import table
from partita.llm.decontaminate import contamination
from partita.llm.exact_dedup import exact_dedup
from partita.llm.html_extract import extract_pages
from partita.llm.license_scan import license_scan
from partita.llm.license_scan import oracle as license_oracle
from partita.llm.mixing import mix_sources
from partita.llm.ngram_join import ngram_components
from partita.llm.pii import KINDS, find_personal_data
from partita.llm.quality import quality
from partita.llm.toxicity import toxicity


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).drop("group")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.col("counts")[k].alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 to 2: bad, good but toxic, good; a document is selected if its grade is likely above 0."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), grade, 3)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentences", ",").alias("sentences"), "n_known", F.array_join("licenses", ",").alias("licenses"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(given.unionByName(hostile_conversation(spark))))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_toxicity": op2_toxicity,
    "op3_personal_data": op3_personal_data,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_license_scan": op7_license_scan,
    "op8_chat_format": op8_chat_format,
    "op9_decontaminate": op9_decontaminate,
    "op10_mix_sources": op10_mix_sources,
}

ORACLES = {
    "op1_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
          SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1) + 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w
        ), t AS (SELECT doc_id, unnest(s) AS t FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (
          SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b
          WHERE 100 * c.n >= 80 * (len(x.s) + len(y.s) - c.n)
        ), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id FROM s JOIN r USING (doc_id) GROUP BY ALL
    """,
    "op5_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents
        ), g AS (
          SELECT plain, arg_min(doc_id, (-length(text), doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY plain
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM n JOIN g USING (plain)
    """,
    "op7_license_scan": license_oracle(),
    "op8_chat_format": r"""
        WITH c AS (
          SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), t AS (
          SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
            lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after,
            length(text) + length(text) - length(replace(text, '\', ''))
              + length(text) - length(regexp_replace(text, '#{3,}', '', 'g')) - 2 * len(regexp_extract_all(text, '#{3,}'))
              + len(regexp_extract_all(text, '</turn>')) + length('### ') + length(role) + length(':  </turn>') + 1 AS shown
          FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
          sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          sum(shown)::BIGINT AS formatted_chars,
          bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
            ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END
            AND (after IS NOT NULL OR role = 'assistant')) AS valid
        FROM t GROUP BY conv_id
    """,
    "op9_decontaminate": r"""
        WITH i AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), iw AS (
          SELECT DISTINCT item_id, n, array_to_string(w[p:p+n-1], ' ') AS s
          FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(13, len(w)) AS n FROM i) WHERE n > 0)
        ), d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), dw AS (
          SELECT doc_id, p, n, array_to_string(w[p:p+n-1], ' ') AS s
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
        ), h AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
        c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
        g AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)
    """,
    "op10_mix_sources": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
            -ln((('0x' || substr(md5('mix:' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
              / greatest(0.1 + length(regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g')) / greatest(length(coalesce(text, '')), 1), 1e-9) AS key
          FROM documents
        ), s AS (
          SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
        ), w AS (
          SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
            2.0::DOUBLE * source_size AS cap FROM s
        ), r AS (
          SELECT 0 AS step, source, source_size, weight, cap, false AS done FROM w
          UNION ALL
          SELECT step + 1, source, source_size, weight, cap, done OR weight * share > cap
          FROM (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE done) OVER (), 0)) / sum(weight) FILTER (WHERE NOT done) OVER () AS share
                FROM r) WHERE step < (SELECT count(*) FROM s)
        ), last AS (
          SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE done) OVER (), 0)) / sum(weight) FILTER (WHERE NOT done) OVER () AS share
          FROM r WHERE step = (SELECT count(*) FROM s)
        ), t AS (
          SELECT source, source_size, CASE WHEN done OR share IS NULL THEN cap ELSE weight * share END AS target FROM last
        ), p AS (
          SELECT d.doc_id, d.size, t.source_size, t.target,
            coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
            CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size::BIGINT AS size, source_size, target,
          (epochs * size + least(size, greatest(0, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
        FROM p
    """,
}
