"""Components of all orders against union-find."""

import random

from partita.queries import QUERIES


def test_every_order_has_a_component(spark, tmp_path):
    rng = random.Random(3)
    rows = [(o, 40 * (o % 3) + rng.randrange(40)) for o in range(60) for _ in range(2)] + [(100, 500), (101, 501), (101, 502), (102, 502)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    up = {p: p for _, p in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for o, p in rows:
        a, b = sorted((root(p), root(first.setdefault(o, p))))
        up[b] = a
    want = {}
    for o in first:
        want[root(first[o])] = want.get(root(first[o]), 0) + 1
    got = {r["component"]: r["size"] for r in QUERIES["order_components_all"](spark, str(tmp_path)).collect()}
    assert got == want and sum(got.values()) == len(first) and len(want) > 4
