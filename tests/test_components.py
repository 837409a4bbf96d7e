"""Components of the value-flow graph against union-find."""

from collections import Counter

import pyarrow.parquet as pq

from tallyweave.operators import graph
from tallyweave.plans import ledger_queries


def union_find(pairs):
    """{(node, root, size)} with the smallest node as root."""
    parent = {}

    def top(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for u, v in pairs:
        a, b = sorted((top(u), top(v)))
        parent[b] = a
    size = Counter(top(v) for v in parent)
    return {(v, top(v), size[top(v)]) for v in parent}


def test_chain_star_loop_and_nulls(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in (9, 8, 30, 31)] + [(31, 2), (50, 50), (61, 60), (60, 61), (60, 61)]
    got = graph.components(spark.createDataFrame(pairs + [(None, 1), (3, None)], "u long, v long")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == union_find(pairs)


def test_query_takes_all_pairs(spark, data):
    lines, orders = (pq.read_table(f"{data}/{t}.parquet", columns=c).to_pylist() for t, c in (("lineitem", ["l_orderkey", "l_suppkey"]), ("orders", ["o_orderkey", "o_custkey"])))
    customer = {o["o_orderkey"]: o["o_custkey"] for o in orders}
    pairs = [(customer[x["l_orderkey"]], x["l_suppkey"] + 1000000000) for x in lines if x["l_orderkey"] in customer]
    got = ledger_queries.QUERIES["components"](spark, data).collect()
    assert len(got) > 100 and len(got) == len(set(got)) and {tuple(r) for r in got} == union_find(pairs)
