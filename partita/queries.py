"""The partition operators bound to the star-schema and document tables, with their SQL.

Roles: a document is an entry and its lines are its chains (key: the digest of
a line of 12 characters or more; a document without any is keyed by all its
lines, an empty one by itself); an order is an entry and its parts are its
components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.config import DOMINANT_SHARE, SPLITS, Fractions
from partita.functions import text as tx
from partita.functions.hashing import md5_bucket
from partita.operators import assign, audit, leakage, sampling
from partita.operators.clusters import components_of
from partita.operators.filters import Rule, drop_histogram, split_by_rules, with_drop_reason
from partita.operators.radius import radius_join
from partita.operators.tiers import conditioning_targets, entry_classes, ladder, tier_histogram
from partita.plans.build import pair_fingerprint
from partita.session import stage_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SALT, FRACTIONS = "partita", Fractions(0.8, 0.1, 0.1)


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents: keys, components, splits --------------------------------------------------------


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("entry_id"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select("entry_id", F.trim("line").alias("line")).distinct()


def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    long = F.length("line") >= 12
    any_long = lines.groupBy("entry_id").agg(F.bool_or(long).alias("any_long"))
    kept = lines.join(any_long, "entry_id").where(long | ~F.col("any_long"))
    return kept.select("entry_id", F.when(F.col("line") == "", F.concat(F.lit("doc:"), F.col("entry_id"))).otherwise(F.md5("line")).alias("raw_key")).distinct()


#: Components of documents by session and tables: most queries start from them. They are made once unless ``STAGED`` is cleared.
STAGED: dict[tuple[str, str], DataFrame] = {}


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in STAGED:
        STAGED[at] = stage_table(components_of(document_keys(spark, sf_dir)), "components")
    return STAGED[at]


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.with_bucket(assign.component_sizes(components(spark, sf_dir)), SALT).withColumn("pin", F.lit(None).cast("string"))


def hash_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.entry_splits(components(spark, sf_dir), assign.assign_hash(sized(spark, sf_dir), FRACTIONS))


def loose_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split of documents one by one, which leaks."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("entry_id"), assign.by_fractions(md5_bucket("loose", F.col("doc_id")), FRACTIONS).alias("split"))


def order_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("entry_id"), assign.by_fractions(md5_bucket("orders", F.col("o_orderkey")), FRACTIONS).alias("split"))


def order_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's families: part and supplier of each of its lines."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.concat_ws(":", "l_partkey", "l_suppkey").alias("family")).distinct()


def _unit(salt: str, key: str) -> str:
    return f"(('0x' || substr(md5('{salt}:' || {key}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def _by_fractions(unit: str) -> str:
    return f"CASE WHEN {unit} < 0.8::DOUBLE THEN 'train' WHEN {unit} < {FRACTIONS.train + FRACTIONS.val!r}::DOUBLE THEN 'val' ELSE 'test' END"


_KEYS = """
  ln AS (SELECT DISTINCT doc_id AS entry_id, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
  lf AS (SELECT *, bool_or(length(line) >= 12) OVER (PARTITION BY entry_id) AS any_long FROM ln),
  k AS (SELECT DISTINCT entry_id, CASE WHEN line = '' THEN 'doc:' || entry_id ELSE md5(line) END AS raw_key FROM lf WHERE length(line) >= 12 OR NOT any_long)"""
_COMPONENTS = f"""{_KEYS},
  st AS (SELECT entry_id AS a, min(entry_id) OVER (PARTITION BY raw_key) AS b FROM k),
  ed AS (SELECT a, b FROM st WHERE a <> b UNION SELECT b, a FROM st WHERE a <> b),
  re(entry_id, other) AS (SELECT DISTINCT entry_id, entry_id FROM k UNION SELECT re.entry_id, ed.b FROM re JOIN ed ON ed.a = re.other),
  c AS (SELECT re.entry_id, min(k.raw_key) AS component FROM re JOIN k ON k.entry_id = re.other GROUP BY 1)"""
_SIZED = f"""{_COMPONENTS},
  sz AS (SELECT component, count(*) AS size, {_unit(SALT, "component")} AS bucket FROM c GROUP BY 1)"""
_HASHED = f"""{_SIZED},
  cs AS (SELECT *, {_by_fractions("bucket")} AS split FROM sz),
  es AS (SELECT c.entry_id, component, split FROM c JOIN cs USING (component))"""
_LOOSE = f"ls AS (SELECT doc_id AS entry_id, {_by_fractions(_unit('loose', 'doc_id'))} AS split FROM documents)"
_ORDERS = f"""
  os AS (SELECT o_orderkey AS entry_id, {_by_fractions(_unit("orders", "o_orderkey"))} AS split FROM orders),
  fa AS (SELECT DISTINCT l_orderkey AS entry_id, l_partkey || ':' || l_suppkey AS family FROM lineitem),
  tr AS (SELECT DISTINCT family FROM fa JOIN os USING (entry_id) WHERE split = 'train')"""
_NOVEL = f"""{_ORDERS},
  nv AS (SELECT entry_id, split, split <> 'train' AND bool_and(tr.family IS NULL) AS novel FROM fa JOIN os USING (entry_id) LEFT JOIN tr USING (family) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT entry_id, component FROM c")
def doc_components(spark, sf_dir):
    return components(spark, sf_dir)


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT component, count(*) AS size FROM c GROUP BY 1")
def doc_component_sizes(spark, sf_dir):
    return assign.component_sizes(components(spark, sf_dir))


@query("""SELECT doc_id AS entry_id, md5(string_agg(line, chr(31) ORDER BY line)) AS sequence_group
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY 1""")
def doc_sequence_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = F.array_sort(F.split(F.coalesce("text", F.lit("")), "\n"))
    return docs.select(F.col("doc_id").alias("entry_id"), F.md5(F.array_join(lines, "\x1f")).alias("sequence_group"))


@query(f"""WITH RECURSIVE {_HASHED}
  SELECT s.split, coalesce(n, 0) AS entries, coalesce(m, 0) AS components FROM (VALUES ('train'), ('val'), ('test')) s(split)
  LEFT JOIN (SELECT split, count(*) AS n, count(DISTINCT component) AS m FROM es GROUP BY 1) g USING (split)""")
def split_hash(spark, sf_dir):
    return assign.split_counts(hash_splits(spark, sf_dir))


@query(f"WITH RECURSIVE {_HASHED} SELECT entry_id, component, split FROM es")
def split_hash_entries(spark, sf_dir):
    return hash_splits(spark, sf_dir)


_BALANCED = f"""{_SIZED},
  tot AS (SELECT sum(size)::BIGINT AS n FROM sz),
  b0 AS (SELECT sz.*, size > {DOMINANT_SHARE!r}::DOUBLE * n AS capped FROM sz, tot),
  b1 AS (SELECT *, coalesce(sum(size) OVER (ORDER BY bucket, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b0 WHERE NOT capped),
  b2 AS (SELECT component, size, bucket FROM b1, tot WHERE before >= 0.1::DOUBLE * n),
  b3 AS (SELECT *, coalesce(sum(size) OVER (ORDER BY bucket, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b2),
  ba AS (SELECT component, size, 'train' AS split FROM b0 WHERE capped UNION ALL SELECT component, size, 'test' FROM b1, tot WHERE before < 0.1::DOUBLE * n
    UNION ALL SELECT component, size, CASE WHEN before < 0.1::DOUBLE * n THEN 'val' ELSE 'train' END FROM b3, tot)"""


@query(f"WITH RECURSIVE {_BALANCED} SELECT component, split FROM ba")
def split_balanced(spark, sf_dir):
    return assign.assign_balanced(sized(spark, sf_dir), FRACTIONS)[0]


@query(f"""WITH RECURSIVE {_BALANCED}, t AS (SELECT coalesce(sum(size) FILTER (WHERE split = 'val'), 0) AS v, coalesce(sum(size) FILTER (WHERE split = 'test'), 0) AS t FROM ba)
  SELECT (SELECT count(*) FROM b0 WHERE capped) AS n_capped, CASE WHEN 0.1::DOUBLE * n - v > 0.5 THEN trunc(0.1::DOUBLE * n - v)::BIGINT ELSE 0 END AS gap_val,
    CASE WHEN 0.1::DOUBLE * n - t > 0.5 THEN trunc(0.1::DOUBLE * n - t)::BIGINT ELSE 0 END AS gap_test FROM t, tot""")
def split_balanced_gaps(spark, sf_dir):
    return assign.assign_balanced(sized(spark, sf_dir), FRACTIONS)[1]


_MAXIMAL = f"""{_SIZED},
  od AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY bucket, component) AS rn, ({FRACTIONS.val!r}::DOUBLE + {FRACTIONS.test!r}::DOUBLE) * sum(size) OVER () AS ceil FROM sz),
  mx(rn, component, split, v, t, capped) AS (
    SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, false
    UNION ALL SELECT od.rn, od.component, CASE WHEN v + t + size > ceil THEN 'train' WHEN v <= t THEN 'val' ELSE 'test' END,
      CASE WHEN v + t + size <= ceil AND v <= t THEN v + size ELSE v END, CASE WHEN v + t + size <= ceil AND v > t THEN t + size ELSE t END, v + t + size > ceil
    FROM mx JOIN od ON od.rn = mx.rn + 1)"""


@query(f"WITH RECURSIVE {_MAXIMAL} SELECT component, split FROM mx WHERE rn > 0")
def split_maximal(spark, sf_dir):
    return assign.assign_maximal(sized(spark, sf_dir), FRACTIONS)[0]


def _class_counts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("entry_id"))
    return components(spark, sf_dir).join(labels, "entry_id").groupBy("component").agg(F.count("*").alias("n")).withColumn("class", F.lit("toxic"))


@query(f"""WITH RECURSIVE {_HASHED},
  cc AS (SELECT component, count(*) AS n FROM c JOIN labels ON doc_id = entry_id WHERE toxic = 1 GROUP BY 1),
  hv AS (SELECT coalesce(sum(n), 0) AS h FROM cs JOIN cc USING (component) WHERE split = 'test'),
  el AS (SELECT component, coalesce(sum(n) OVER (ORDER BY size, bucket, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM cs JOIN cc USING (component) WHERE split <> 'test')
  SELECT component, CASE WHEN before + h < 25 THEN 'test' ELSE split END AS split FROM cs LEFT JOIN el USING (component), hv""")
def split_test_minimums(spark, sf_dir):
    base = sized(spark, sf_dir)
    return assign.enforce_minimums(assign.assign_hash(base, FRACTIONS), base, _class_counts(spark, sf_dir), {"toxic": 25}, None)[0]


def _registry(spark, sf_dir):
    """Keys of the first half of the documents, each with the split its own digest gives it."""
    n = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    keys = document_keys(spark, sf_dir).where(F.col("entry_id") * 2 < n).groupBy("entry_id").agg(F.min("raw_key").alias("raw_key")).select("raw_key").distinct()
    return keys.withColumn("split", assign.by_fractions(md5_bucket("prior", F.col("raw_key")), FRACTIONS))


_REGISTRY = f"""{_SIZED},
  rg AS (SELECT raw_key, {_by_fractions(_unit("prior", "raw_key"))} AS prior FROM (
    SELECT DISTINCT min(raw_key) AS raw_key FROM k WHERE entry_id * 2 < (SELECT max(doc_id) FROM documents) GROUP BY entry_id)),
  kc AS (SELECT DISTINCT component, raw_key FROM k JOIN c USING (entry_id)),
  pn AS (SELECT component, ['test', 'val', 'train'][min(CASE prior WHEN 'test' THEN 1 WHEN 'val' THEN 2 ELSE 3 END)] AS pin FROM kc JOIN rg USING (raw_key) GROUP BY 1)"""


@query(f"WITH RECURSIVE {_REGISTRY} SELECT component, pin FROM pn")
def registry_pins(spark, sf_dir):
    return assign.pins(document_keys(spark, sf_dir), components(spark, sf_dir), _registry(spark, sf_dir))


@query(f"""WITH RECURSIVE {_REGISTRY},
  ra AS (SELECT sz.component, size, coalesce(pin, {_by_fractions("bucket")}) AS split FROM sz LEFT JOIN pn USING (component)),
  br AS (SELECT component FROM rg JOIN kc USING (raw_key) JOIN ra USING (component) WHERE prior <> split)
  SELECT (SELECT count(*) FROM br) AS pins, (SELECT coalesce(sum(size), 0)::BIGINT FROM ra WHERE component IN (SELECT component FROM br)) AS entries""")
def registry_reassigned(spark, sf_dir):
    keys, comps, registry = document_keys(spark, sf_dir), components(spark, sf_dir), _registry(spark, sf_dir)
    pinned = sized(spark, sf_dir).drop("pin").join(assign.pins(keys, comps, registry), "component", "left")
    return assign.overridden_pins(assign.assign_hash(pinned, FRACTIONS), keys, comps, registry)


# --- leakage ------------------------------------------------------------------------------------


@query(f"WITH {_KEYS}, {_LOOSE} SELECT raw_key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM k JOIN ls USING (entry_id) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leakage_keys(spark, sf_dir):
    return leakage.straddling(document_keys(spark, sf_dir), loose_splits(spark, sf_dir), "raw_key").withColumn("splits", F.array_join("splits", ","))


@query(f"""WITH RECURSIVE {_HASHED} SELECT count(*) AS keys, count(*) FILTER (WHERE n > 1) AS leaking
  FROM (SELECT raw_key, count(DISTINCT split) AS n FROM k JOIN es USING (entry_id) GROUP BY 1)""")
def leakage_checked(spark, sf_dir):
    keys, splits = document_keys(spark, sf_dir), hash_splits(spark, sf_dir)
    bad = leakage.straddling(keys, splits, "raw_key").agg(F.count("*").alias("leaking"))
    return keys.agg(F.countDistinct("raw_key").alias("keys")).crossJoin(bad)


@query(f"WITH {_LOOSE} SELECT source AS family, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM documents JOIN ls ON doc_id = entry_id GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leakage_families(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("source").alias("family"))
    return leakage.straddling(rows, loose_splits(spark, sf_dir), "family").withColumn("splits", F.array_join("splits", ","))


@query(f"""WITH {_NOVEL}, g AS (SELECT family, tr.family IS NULL AS novel FROM (SELECT DISTINCT family FROM fa JOIN os USING (entry_id) WHERE split = 'test') LEFT JOIN tr USING (family))
  SELECT (SELECT count(*) FROM os WHERE split = 'test') AS n_test, (SELECT count(*) FROM nv WHERE split = 'test') AS n_test_classified,
    (SELECT count(*) FROM nv WHERE split = 'test' AND novel) AS n_test_novel_fold, (SELECT count(*) FROM g) AS n_test_distinct_folds, (SELECT count(*) FROM g WHERE novel) AS n_test_novel_folds""")
def fold_benchmark(spark, sf_dir):
    return leakage.benchmark_summary(order_families(spark, sf_dir), order_splits(spark, sf_dir))


@query(f"""WITH {_ORDERS} SELECT family, bool_and(tr.family IS NULL) AS novel, string_agg(DISTINCT fa.entry_id::VARCHAR, ',' ORDER BY fa.entry_id::VARCHAR) AS test_entries
  FROM fa JOIN os USING (entry_id) LEFT JOIN tr USING (family) WHERE split = 'test' GROUP BY 1""")
def fold_groups(spark, sf_dir):
    out = leakage.family_groups(order_families(spark, sf_dir), order_splits(spark, sf_dir))
    return out.withColumn("test_entries", F.array_join(F.array_sort(F.transform("test_entries", lambda x: x.cast("string"))), ","))


@query(f"WITH {_NOVEL} SELECT entry_id, split FROM nv WHERE novel")
def novel_entries(spark, sf_dir):
    return leakage.certified_novel(order_families(spark, sf_dir), order_splits(spark, sf_dir))


@query(f"""WITH {_ORDERS}, hp AS (SELECT fa.entry_id, count(DISTINCT t.entry_id) AS pool FROM fa JOIN os USING (entry_id)
    LEFT JOIN (SELECT fa.entry_id, family FROM fa JOIN os USING (entry_id) WHERE split = 'train') t USING (family) WHERE split <> 'train' GROUP BY 1),
  o AS (SELECT pool, row_number() OVER (ORDER BY pool) - 1 AS pos, count(*) OVER () AS n FROM hp)
  SELECT n, median(pool)::DOUBLE AS median, avg(pool)::DOUBLE AS mean, max(pool) FILTER (WHERE pos = (9 * n) // 10) AS p90, count(*) FILTER (WHERE pool = 0) AS zeros FROM o GROUP BY n""")
def pool_stats(spark, sf_dir):
    return leakage.pool_statistics(leakage.pool_sizes(order_families(spark, sf_dir), order_splits(spark, sf_dir)))


@query(f"""WITH {_KEYS}, {_LOOSE}, t AS (SELECT DISTINCT raw_key FROM k JOIN ls USING (entry_id) WHERE split = 'train'),
  h AS (SELECT split, entry_id, bool_or(t.raw_key IS NOT NULL) AS leaky FROM k JOIN ls USING (entry_id) LEFT JOIN t USING (raw_key) WHERE split <> 'train' GROUP BY 1, 2)
  SELECT split, count(*) AS held, count(*) FILTER (WHERE leaky) AS leaky FROM h GROUP BY 1""")
def co_cluster_leak(spark, sf_dir):
    return leakage.co_occupancy(document_keys(spark, sf_dir), loose_splits(spark, sf_dir))


@query(f"""WITH RECURSIVE {_COMPONENTS}, {_LOOSE}, t AS (SELECT DISTINCT component FROM c JOIN ls USING (entry_id) WHERE split = 'train')
  SELECT split, count(*) AS held, count(t.component) AS leaky FROM c JOIN ls USING (entry_id) LEFT JOIN t USING (component) WHERE split <> 'train' GROUP BY 1""")
def bridge_leak(spark, sf_dir):
    return leakage.bridge_leakage(components(spark, sf_dir), loose_splits(spark, sf_dir))


@query(f"""WITH {_ORDERS}, pc AS (SELECT DISTINCT split, l_suppkey::VARCHAR AS family, p_brand AS class FROM lineitem JOIN part ON p_partkey = l_partkey JOIN os ON entry_id = l_orderkey)
  SELECT h.split, count(*) AS pairs, count(t.family) AS seen FROM pc h LEFT JOIN (SELECT family, class FROM pc WHERE split = 'train') t USING (family, class) WHERE h.split <> 'train' GROUP BY 1""")
def pair_context_leak(spark, sf_dir):
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("entry_id"), F.col("l_suppkey").cast("string").alias("family"), F.col("p_brand").alias("class")).distinct()
    return leakage.pair_context(rows, order_splits(spark, sf_dir))


_LEAKY = f"""{_NOVEL}, lk AS (SELECT nv.entry_id, NOT novel AS leaky, o_totalprice, o_orderdate FROM nv JOIN orders ON o_orderkey = entry_id WHERE split <> 'train')"""


def _leaky(spark, sf_dir):
    held = leakage.novelty(order_families(spark, sf_dir), order_splits(spark, sf_dir)).where("split <> 'train'")
    return held.join(table(spark, sf_dir, "orders"), F.col("entry_id") == F.col("o_orderkey")).withColumn("leaky", ~F.col("novel"))


@query(f"""WITH {_LEAKY} SELECT CASE WHEN o_totalprice < 50000 THEN '0-50000' WHEN o_totalprice < 150000 THEN '50000-150000' WHEN o_totalprice < 300000 THEN '150000-300000' ELSE '300000-inf' END AS bin,
  count(*) AS n, count(*) FILTER (WHERE leaky) AS leaking, 100.0::DOUBLE * count(*) FILTER (WHERE leaky) / count(*) AS pct FROM lk GROUP BY 1""")
def leak_by_bin(spark, sf_dir):
    price = F.col("o_totalprice")
    bins = F.when(price < 50000, "0-50000").when(price < 150000, "50000-150000").when(price < 300000, "150000-300000").otherwise("300000-inf")
    return leakage.leak_rate(_leaky(spark, sf_dir), bins)


@query(f"WITH {_LEAKY} SELECT year(o_orderdate)::INT AS bin, count(*) AS n, count(*) FILTER (WHERE leaky) AS leaking, 100.0::DOUBLE * count(*) FILTER (WHERE leaky) / count(*) AS pct FROM lk GROUP BY 1")
def leak_by_year(spark, sf_dir):
    return leakage.leak_rate(_leaky(spark, sf_dir), F.year("o_orderdate"))


# --- filters, tiers, targets --------------------------------------------------------------------


def _document_rules() -> list[Rule]:
    n, words = F.col("n_chars"), F.size(F.split(F.trim("text"), r"\s+"))
    return [
        Rule("no_text", F.trim("text") == ""), Rule("too_short", n < 100, n), Rule("too_large", n > 5000, n), Rule("few_words", words < 20, words),
        Rule("quality_too_low", F.col("quality") < 1, F.col("quality")), Rule("toxic", F.col("toxic") > 0, F.col("toxic")),
    ]


def _rated(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


_LADDER = r"""
  w AS (SELECT d.doc_id, n_chars, len(string_split_regex(trim(text), '\s+')) AS words, trim(text) = '' AS blank, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
  r AS (SELECT doc_id, CASE WHEN blank THEN 'no_text' WHEN n_chars < 100 THEN 'too_short' WHEN n_chars > 5000 THEN 'too_large' WHEN words < 20 THEN 'few_words'
      WHEN quality < 1 THEN 'quality_too_low' WHEN toxic > 0 THEN 'toxic' END AS drop_reason,
    CASE WHEN blank THEN NULL WHEN n_chars < 100 OR n_chars > 5000 THEN n_chars WHEN words < 20 THEN words WHEN quality < 1 THEN quality WHEN toxic > 0 THEN toxic END::DOUBLE AS drop_value FROM w)"""


@query(f"WITH {_LADDER} SELECT * FROM r")
def filter_ladder(spark, sf_dir):
    return with_drop_reason(_rated(spark, sf_dir), _document_rules()).select("doc_id", "drop_reason", "drop_value")


@query(f"WITH {_LADDER} SELECT drop_reason AS reason, count(*) AS n FROM r WHERE drop_reason IS NOT NULL GROUP BY 1")
def drop_reasons(spark, sf_dir):
    return drop_histogram(split_by_rules(_rated(spark, sf_dir), _document_rules())[1])


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice <= 200000 AND o_orderdate <= TIMESTAMP '1996-06-30 23:59:59' ORDER BY o_orderkey LIMIT 500""")
def snapshot_scan(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").where("o_orderstatus in ('O', 'P') and o_totalprice <= 200000 and o_orderdate <= timestamp'1996-06-30 23:59:59'")
    return chosen.select("o_orderkey").orderBy("o_orderkey").limit(500)


def _tiers(spark, sf_dir):
    """Parts of an order as its components; flags from the line."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.max("l_discount").alias("disc"))
    rows = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    metal, size = F.col("p_type").isin("STANDARD", "PROMO", "LARGE"), F.col("p_size")
    tier = ladder([
        (size == 1, "artifact", "counterion", None), (metal & (F.col("q") >= 48), "functional", "metal_affinity", "metal"),
        (metal & F.col("returned"), "functional", "metal_annotated", "metal"), (metal & (size > 45), "ambiguous", "phasing_metal", None),
        (metal & (F.col("disc") >= 0.08), "ambiguous", "metal_site_nonnative", None), (metal, "ambiguous", "metal_unbound", None),
        (F.col("q") >= 45, "functional", "ligand_affinity", "small_molecule"), (size < 5, "ambiguous", "glycan", None),
        (F.col("returned"), "functional", "ligand_investigated", "small_molecule"), (F.lit(True), "artifact", "additive", None),
    ])
    return rows.select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").cast("string").alias("comp_id"), tier.alias("t"), F.when(metal, "metal").otherwise("small_molecule").alias("would_be")).select("entry_id", "comp_id", "t.tier", "t.reason", "t.class", "would_be")


_TIERS = """
  li AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS q, bool_or(l_returnflag = 'R') AS returned, max(l_discount) AS disc FROM lineitem GROUP BY 1, 2),
  t0 AS (SELECT l_orderkey AS entry_id, l_partkey::VARCHAR AS comp_id, q, returned, disc, p_size, p_type IN ('STANDARD', 'PROMO', 'LARGE') AS metal FROM li JOIN part ON p_partkey = l_partkey),
  t1 AS (SELECT entry_id, comp_id, metal, CASE WHEN p_size = 1 THEN 'counterion' WHEN metal AND q >= 48 THEN 'metal_affinity' WHEN metal AND returned THEN 'metal_annotated'
    WHEN metal AND p_size > 45 THEN 'phasing_metal' WHEN metal AND disc >= 0.08 THEN 'metal_site_nonnative' WHEN metal THEN 'metal_unbound' WHEN q >= 45 THEN 'ligand_affinity'
    WHEN p_size < 5 THEN 'glycan' WHEN returned THEN 'ligand_investigated' ELSE 'additive' END AS reason FROM t0),
  t AS (SELECT entry_id, comp_id, CASE WHEN reason IN ('counterion', 'additive') THEN 'artifact' WHEN reason IN ('metal_affinity', 'metal_annotated', 'ligand_affinity', 'ligand_investigated')
    THEN 'functional' ELSE 'ambiguous' END AS tier, reason, CASE WHEN reason IN ('metal_affinity', 'metal_annotated') THEN 'metal' WHEN reason IN ('ligand_affinity', 'ligand_investigated') THEN 'small_molecule' END AS class,
    CASE WHEN metal THEN 'metal' ELSE 'small_molecule' END AS would_be FROM t1)"""


@query(f"WITH {_TIERS} SELECT entry_id, comp_id, tier, reason, class FROM t")
def tier_ladder(spark, sf_dir):
    return _tiers(spark, sf_dir).drop("would_be")


@query(f"WITH {_TIERS} SELECT tier || ':' || reason AS tier_reason, count(*) AS n FROM t GROUP BY 1")
def tier_reasons(spark, sf_dir):
    return tier_histogram(_tiers(spark, sf_dir))


@query(f"""WITH {_TIERS} SELECT entry_id, coalesce(string_agg(DISTINCT class, ',' ORDER BY class) FILTER (WHERE tier = 'functional'), '') AS classes,
  array_to_string(list_sort(list_filter(list_distinct(list(CASE WHEN tier = 'ambiguous' THEN would_be END)), lambda x: x IS NOT NULL AND NOT list_contains(list(CASE WHEN tier = 'functional' THEN class END), x))), ',') AS ambiguous_classes
  FROM t GROUP BY 1""")
def entry_class_map(spark, sf_dir):
    out = entry_classes(_tiers(spark, sf_dir).withColumn("purification_artifact", F.lit(False)))
    return out.select("entry_id", F.array_join("classes", ",").alias("classes"), F.array_join("ambiguous_classes", ",").alias("ambiguous_classes"))


_TARGETS = f"""{_ORDERS}, {_TIERS},
  tg AS (SELECT t.entry_id, split, t.entry_id::VARCHAR AS cluster, CASE WHEN tier = 'functional' THEN class WHEN reason = 'glycan' THEN 'small_molecule' ELSE 'metal' END AS class, comp_id, tier, reason
    FROM t JOIN os USING (entry_id) WHERE tier = 'functional' OR reason IN ('metal_site_nonnative', 'glycan'))"""


def _targets(spark, sf_dir):
    splits = order_splits(spark, sf_dir)
    return conditioning_targets(_tiers(spark, sf_dir), splits, splits.select("entry_id", F.col("entry_id").cast("string").alias("component")))


@query(f"WITH {_TARGETS} SELECT * FROM tg")
def targets(spark, sf_dir):
    return _targets(spark, sf_dir)


@query(f"WITH {_TARGETS} SELECT split, class, tier, count(*) AS n, count(DISTINCT entry_id) AS entries FROM tg GROUP BY ALL")
def targets_by_split_class(spark, sf_dir):
    return _targets(spark, sf_dir).groupBy("split", "class", "tier").agg(F.count("*").alias("n"), F.countDistinct("entry_id").alias("entries"))


@query(f"""WITH {_TARGETS} SELECT o_orderkey AS entry_id FROM orders WHERE o_orderkey IN (SELECT entry_id FROM tg WHERE tier = 'functional' AND class = 'metal')""")
def conditioned_entries(spark, sf_dir):
    chosen = _targets(spark, sf_dir).where("tier = 'functional' and class = 'metal'")
    return order_splits(spark, sf_dir).select("entry_id").join(chosen, "entry_id", "left_semi")


@query(f"WITH {_TARGETS} SELECT split, class, count(*) AS n FROM (SELECT DISTINCT split, class, entry_id FROM tg) GROUP BY CUBE (split, class) HAVING grouping(class) = 0")
def class_counts(spark, sf_dir):
    return audit.class_counts(_targets(spark, sf_dir), "split", "class")


# --- samples and weights ------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_COMPONENTS} SELECT component, arg_min(entry_id, (md5('7:' || entry_id), entry_id)) AS entry_id, md5('7:' || component) AS group_rank FROM c GROUP BY component""")
def sample_by_group(spark, sf_dir):
    return sampling.sample_one_per_group(components(spark, sf_dir), "component", 7)


@query("""WITH g AS (SELECT doc_id AS entry_id, md5(string_agg(line, chr(31) ORDER BY line)) AS sequence_group FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY 1)
  SELECT sequence_group, arg_min(entry_id, (md5('7:' || entry_id), entry_id)) AS entry_id, md5('7:' || sequence_group) AS group_rank FROM g GROUP BY sequence_group""")
def sample_by_sequence(spark, sf_dir):
    return sampling.sample_one_per_group(doc_sequence_groups(spark, sf_dir), "sequence_group", 7)


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT entry_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY component) AS weight FROM c")
def redundancy_weights(spark, sf_dir):
    return sampling.redundancy_weights(components(spark, sf_dir), "component")


@query(f"""WITH RECURSIVE {_HASHED}, g AS (SELECT split, component, count(*) AS n FROM es GROUP BY 1, 2)
  SELECT split, sum(n)::BIGINT AS entries, count(*) AS distinct_groups, max(n) AS largest, (sum(n) - count(*))::DOUBLE / sum(n)::DOUBLE AS redundancy FROM g GROUP BY 1""")
def redundancy_by_split(spark, sf_dir):
    return audit.redundancy(hash_splits(spark, sf_dir), "split", "component")


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey FROM o WHERE pos IN (SELECT floor(i * (n::DOUBLE / 300))::BIGINT FROM range(300) r(i))""")
def stride_sample(spark, sf_dir):
    return sampling.stride_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 300)


@query("SELECT o_orderkey FROM orders ORDER BY md5('11:' || o_orderkey), o_orderkey LIMIT 300")
def seeded_sample(spark, sf_dir):
    return sampling.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 300, 11)


# --- audits -------------------------------------------------------------------------------------


def _lists(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("list"), F.col("o_custkey").alias("id"))


@query("""WITH l AS (SELECT DISTINCT o_orderpriority AS list, o_custkey AS id FROM orders), n AS (SELECT DISTINCT list FROM l)
  SELECT a.list AS list_a, b.list AS list_b, (SELECT count(*) FROM l x JOIN l y USING (id) WHERE x.list = a.list AND y.list = b.list) AS shared FROM n a JOIN n b ON a.list < b.list""")
def list_overlap_pairs(spark, sf_dir):
    return audit.list_overlaps(_lists(spark, sf_dir))


@query("SELECT o_orderpriority AS list, count(*) AS total, count(DISTINCT o_custkey) AS distinct_ids, count(*) - count(DISTINCT o_custkey) AS duplicates FROM orders GROUP BY 1")
def list_duplicates(spark, sf_dir):
    return audit.list_sizes(_lists(spark, sf_dir))


@query("""SELECT o_custkey AS id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS lists, count(*) AS "rows" FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1""")
def list_straddlers(spark, sf_dir):
    return audit.straddlers(_lists(spark, sf_dir)).withColumn("lists", F.array_join("lists", ","))


@query("""SELECT o_custkey, ['F', 'P', 'O'][min(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 WHEN 'O' THEN 3 END)] AS o_orderstatus, count(DISTINCT o_orderstatus) > 1 AS straddles FROM orders GROUP BY 1""")
def rollup_precedence(spark, sf_dir):
    return audit.rollup_precedence(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ("F", "P", "O"))


@query("SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS o_orderpriority FROM orders GROUP BY 1")
def last_label(spark, sf_dir):
    return audit.last_label(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderdate")


@query(f"""WITH {_KEYS}, f AS (SELECT line, count(DISTINCT entry_id) AS fan_out, max(length(line)) AS len FROM ln GROUP BY 1)
  SELECT t AS threshold, count(line) AS items, coalesce(max(fan_out), 0) AS max_fan_out FROM (VALUES (1), (12), (40), (80), (160)) v(t) LEFT JOIN f ON len >= t GROUP BY 1""")
def fanout_thresholds(spark, sf_dir):
    return audit.fan_out_by_threshold(document_lines(spark, sf_dir), "line", "entry_id", F.length("line"), [1, 12, 40, 80, 160])


@query(f"WITH {_KEYS} SELECT raw_key, count(DISTINCT entry_id) AS fan_out FROM k GROUP BY 1 ORDER BY fan_out DESC, raw_key LIMIT 20")
def fanout_topk(spark, sf_dir):
    return audit.fan_out(document_keys(spark, sf_dir), "raw_key", "entry_id").orderBy(F.desc("fan_out"), "raw_key").limit(20)


@query(f"""WITH {_LADDER}, g AS (SELECT drop_reason, count(*) AS n, list_sort(list(doc_id))[1:8] AS x FROM r WHERE drop_reason IS NOT NULL GROUP BY 1)
  SELECT drop_reason, n, array_to_string(x, ',') AS examples FROM g ORDER BY n DESC, drop_reason LIMIT 3""")
def top_reasons(spark, sf_dir):
    rows = with_drop_reason(_rated(spark, sf_dir), _document_rules()).where("drop_reason is not null")
    return audit.top_k(rows, "drop_reason", 3, "doc_id").withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query(f"""WITH {_LOOSE}, d AS (SELECT split, doc_id, quality FROM documents JOIN ls ON doc_id = entry_id LEFT JOIN labels USING (doc_id))
  SELECT split, count(DISTINCT doc_id) AS entries, count(DISTINCT doc_id) FILTER (WHERE quality IS NOT NULL) AS classified, count(DISTINCT quality) AS families,
    count(DISTINCT doc_id) - count(DISTINCT doc_id) FILTER (WHERE quality IS NOT NULL) AS unclassified FROM d GROUP BY 1""")
def coverage_by_authority(spark, sf_dir):
    rows = _rated(spark, sf_dir).select(F.col("doc_id").alias("entry_id"), "quality").join(loose_splits(spark, sf_dir), "entry_id")
    return audit.coverage(rows, "split", "quality")


@query(f"""WITH RECURSIVE {_HASHED}, n AS (SELECT split, count(*) AS n FROM es GROUP BY 1)
  SELECT split, 100.0::DOUBLE * n / sum(n) OVER () AS pct, CASE split WHEN 'train' THEN 100.0::DOUBLE * 0.8::DOUBLE ELSE 100.0::DOUBLE * 0.1::DOUBLE END AS target_pct,
    100.0::DOUBLE * n / sum(n) OVER () - CASE split WHEN 'train' THEN 100.0::DOUBLE * 0.8::DOUBLE ELSE 100.0::DOUBLE * 0.1::DOUBLE END AS drift FROM n""")
def split_drift(spark, sf_dir):
    counts = hash_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("entries"))
    return audit.drift(counts, {"train": 0.8, "val": 0.1, "test": 0.1})


@query("""SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE contains(p_type, 'PROMO')) AS promo, count(*) FILTER (WHERE p_size >= 25) AS large FROM part GROUP BY 1""")
def composition(spark, sf_dir):
    return audit.satisfies(table(spark, sf_dir, "part"), "p_brand", {"promo": F.col("p_type").contains("PROMO"), "large": F.col("p_size") >= 25})


def _early(spark, sf_dir, salt):
    orders = table(spark, sf_dir, "orders").where("o_orderdate < timestamp'1997-01-01'")
    return orders.select(F.col("o_orderkey").alias("entry_id"), assign.by_fractions(md5_bucket(salt, F.col("o_orderkey")), FRACTIONS).alias("split"))


@query(f"""WITH a AS (SELECT o_orderkey, {_by_fractions(_unit("v1", "o_orderkey"))} AS was, {_by_fractions(_unit("orders", "o_orderkey"))} AS now FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')
  SELECT count(*) AS moved, count(*) FILTER (WHERE now = 'train') AS into_train, count(*) FILTER (WHERE was = 'train') AS out_of_train FROM a WHERE was <> now""")
def rebuild_diff(spark, sf_dir):
    return leakage.moved_entries(_early(spark, sf_dir, "v1"), order_splits(spark, sf_dir))


@query("""SELECT o_orderkey AS entry_id, CASE WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'removed' ELSE 'added' END AS change FROM orders
  WHERE (o_orderdate < TIMESTAMP '1994-01-01') <> (o_orderdate >= TIMESTAMP '1997-01-01')""")
def id_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), "o_orderdate")
    before = rows.where("o_orderdate < timestamp'1997-01-01'").select("entry_id")
    after = rows.where("o_orderdate >= timestamp'1994-01-01'").select("entry_id")
    return leakage.id_drift(before, after)


@query(r"""WITH b AS (SELECT DISTINCT item_id, trim(line) AS line FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE length(trim(line)) >= 12),
  d AS (SELECT DISTINCT doc_id AS entry_id, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents))
  SELECT entry_id, count(DISTINCT item_id) AS items FROM d JOIN b USING (line) GROUP BY 1""")
def benchmark_contamination(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line")).select("item_id", F.trim("line").alias("line")).where("length(line) >= 12").distinct()
    found = document_lines(spark, sf_dir).join(items, "line")
    return found.groupBy("entry_id").agg(F.countDistinct("item_id").alias("items"))


# --- functions, sources, fingerprints -----------------------------------------------------------


@query(r"""SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(upper(text), '(E+)'), lambda x: length(x))), 0)::INT AS run,
  greatest(coalesce(list_max(list_transform(regexp_extract_all(upper(substr(text, 1, 20)), '(E+)'), lambda x: length(x))), 0), coalesce(list_max(list_transform(regexp_extract_all(upper(right(text, 20)), '(E+)'), lambda x: length(x))), 0))::INT AS edge
  FROM documents""")
def longest_runs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.longest_run(F.col("text"), "E").alias("run"), tx.terminal_run(F.col("text"), "E").alias("edge"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '[0-9]+[+-]?', ' ', 'g'), '[A-Z][a-z]?'), lambda x: upper(x)))), ',') AS elements FROM documents""")
def formula_elements(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.formula_elements(F.col("text")), ",").alias("elements"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'NI' WHEN 1 THEN 'METAL' WHEN 2 THEN 'CU,ZN' WHEN 3 THEN 'YB' ELSE '' END AS metals FROM part""")
def metal_terms(spark, sf_dir):
    said = F.array(*map(F.lit, ("nickel cation binding", "transition metal ion binding", "Zinc, or copper", "ytterbium", "binding")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.metal_symbols(F.concat_ws(" ", "p_name", F.get(said, F.col("p_size") % 5))), ",").alias("metals"))


@query("""SELECT c_custkey, 'structures/' || lower(c_mktsegment) || '/' || substr(lower(c_name), 2, 2) || '/' || lower(c_name) || '-assembly1.cif.gz' AS path FROM customer""")
def path_functions(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.relative_path(F.col("c_name"), F.lower("c_mktsegment"), True).alias("path"))


@query("SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::INT)::BIGINT AS total, max((props::JSON->>'k')::INT) AS top FROM events GROUP BY 1")
def json_ingest(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("top"))


@query(f"WITH {_ORDERS} SELECT split, count(*) AS n, sha256(string_agg(entry_id || chr(9) || split || chr(10), '' ORDER BY entry_id::VARCHAR)) AS sha256 FROM os GROUP BY 1")
def split_fingerprint(spark, sf_dir):
    rows = order_splits(spark, sf_dir).select(F.col("entry_id").cast("string").alias("entry_id"), "split")
    told = [(s, mine.count(), pair_fingerprint(mine, "entry_id", "split")) for s in SPLITS for mine in [rows.where(F.col("split") == s)]]
    return spark.createDataFrame(told, "split string, n long, sha256 string")


@query("""SELECT s.id AS id, c.id AS r_id FROM (SELECT s_suppkey AS id, s_acctbal / 100 AS x, s_nationkey::DOUBLE AS y FROM supplier) s
  JOIN (SELECT c_custkey AS id, c_acctbal / 100 AS x, c_nationkey::DOUBLE AS y FROM customer) c ON sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) <= 2.5""")
def radius_pairs(spark, sf_dir):
    point = lambda t, k, p: table(spark, sf_dir, t).select(F.col(k).alias("id"), (F.col(f"{p}_acctbal") / 100).alias("x"), F.col(f"{p}_nationkey").cast("double").alias("y"))
    return radius_join(point("supplier", "s_suppkey", "s"), point("customer", "c_custkey", "c"), ("x", "y"), 2.5).select("id", "r_id")


@query("""WITH RECURSIVE k AS (SELECT DISTINCT l_orderkey AS entry_id, l_partkey AS raw_key FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1),
  st AS (SELECT entry_id AS a, min(entry_id) OVER (PARTITION BY raw_key) AS b FROM k), ed AS (SELECT a, b FROM st WHERE a <> b UNION SELECT b, a FROM st WHERE a <> b),
  re(entry_id, other) AS (SELECT DISTINCT entry_id, entry_id FROM k UNION SELECT re.entry_id, ed.b FROM re JOIN ed ON ed.a = re.other),
  c AS (SELECT re.entry_id, min(k.raw_key) AS component FROM re JOIN k ON k.entry_id = re.other GROUP BY 1) SELECT component, count(*) AS size FROM c GROUP BY 1""")
def order_components(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size = 1")
    keys = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("raw_key")).distinct()
    return assign.component_sizes(components_of(keys))


@query("""WITH RECURSIVE k AS (SELECT DISTINCT l_orderkey AS entry_id, l_partkey AS raw_key FROM lineitem WHERE l_partkey IS NOT NULL AND l_orderkey IS NOT NULL),
  l(raw_key, label, moved) AS (SELECT raw_key, raw_key, true FROM (SELECT DISTINCT raw_key FROM k)
    UNION ALL SELECT raw_key, n, bool_or(n < label) OVER () FROM (SELECT l.raw_key, min(l.label) AS label, min(o.m) AS n FROM l JOIN k ON k.raw_key = l.raw_key
      JOIN (SELECT k.entry_id, min(l.label) AS m FROM l JOIN k ON k.raw_key = l.raw_key GROUP BY 1) o ON o.entry_id = k.entry_id WHERE l.moved GROUP BY 1)),
  c AS (SELECT raw_key, min(label) AS component FROM l GROUP BY 1) SELECT component, count(*) AS size FROM (SELECT k.entry_id, min(c.component) AS component FROM k JOIN c ON c.raw_key = k.raw_key GROUP BY 1) GROUP BY 1""")
def order_components_all(spark, sf_dir):
    """Components of all orders of ``lineitem`` that share parts; ``order_components`` takes parts of size 1 only."""
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("raw_key")).distinct()
    return assign.component_sizes(components_of(keys))
