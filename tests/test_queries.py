"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from partita import entry_queries, queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES | entry_queries.QUERIES, queries.ORACLES | entry_queries.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def values(frame):
    def plain(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.9g}"
        return str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert values(QUERIES[name](spark, SF).toPandas()) == values(duck.execute(ORACLES[name]).df())


def test_result_does_not_depend_on_partitions(spark):
    seen = set()
    for n in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        queries.STAGED.clear()
        seen.add(str(values(QUERIES["split_hash_entries"](spark, SF).toPandas())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1
