"""Value-flow graph: adjacency, neighbourhoods, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.session import Scratch


def adjacency(edges: DataFrame) -> DataFrame:
    """(address, other, value_sats, n_txs, dir): every edge from both ends; reciprocal edges stay apart."""
    one = lambda a, b, d: edges.select(F.col(a).alias("address"), F.col(b).alias("other"), "value_sats", "n_txs", F.lit(d).alias("dir"))
    return one("src", "dst", "out").unionByName(one("dst", "src", "in"))


def top_counterparties(adj: DataFrame, k: int = 30) -> DataFrame:
    """The k largest counterparties of every address and direction, ties by address.

    A first cut within salted groups keeps a hub's list out of one task's sort;
    it keeps every row that can be among the k largest.
    """
    order = [F.col("value_sats").desc(), F.col("other")]
    salted = adj.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(16)))
    first = salted.withColumn("r", F.row_number().over(W.partitionBy("address", "dir", "salt").orderBy(*order))).where(F.col("r") <= k)
    return first.withColumn("pos", F.row_number().over(W.partitionBy("address", "dir").orderBy(*order))).where(F.col("pos") <= k).select("address", "dir", "pos", "other", "value_sats", "n_txs")


def ego_network(adj: DataFrame, seed: str, hops: int = 2, max_nodes: int = 160) -> DataFrame:
    """(address, hops) around a seed; where the cap binds, the neighbours with the largest flows are kept.

    At most ``max_nodes`` addresses are ever held, so they travel as a literal list.
    """
    spark = adj.sparkSession
    hops, max_nodes = min(4, max(1, hops)), min(500, max(20, max_nodes))
    dist, frontier = {seed: 0}, [seed]
    for d in range(1, hops + 1):
        room = max_nodes - len(dist)
        if room <= 0 or not frontier:
            break
        near = adj.where(F.col("address").isin(frontier) & ~F.col("other").isin(list(dist)))
        best = near.groupBy("other").agg(F.max("value_sats").alias("v")).orderBy(F.col("v").desc(), "other").limit(room).collect()
        frontier = [r[0] for r in best]
        dist |= dict.fromkeys(frontier, d)
    return spark.createDataFrame(list(dist.items()), "address string, hops int")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    a, b = nodes.select(F.col("address").alias("src")), nodes.select(F.col("address").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def components(pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root, size) of an undirected pair list (u, v); the root is the smallest node.

    Minimum labels over edges, with a jump to the label's own label in each
    round, so chains shrink by halves. Each round is written to the shared
    folder. Nulls are left out; a pair of a node with itself makes a component.
    """
    with Scratch(pairs.sparkSession) as scratch:
        scratch.hold("labels0", "labels1")
        pairs = pairs.where("u is not null and v is not null")
        both = scratch.keep(pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
        labels = scratch.keep(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root")), "labels")
        for r in range(max_rounds):
            told = both.join(labels.select(F.col("node").alias("u"), "root"), "u").groupBy(F.col("v").alias("node")).agg(F.min("root").alias("told"))
            step = labels.join(told, "node").select("node", F.col("root").alias("old"), F.least("root", "told").alias("root"))
            jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new = step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root"))
            # two names by turns: a round reads the table of the one before
            new = scratch.keep(new, f"labels{r % 2}")
            labels = new.select("node", "root")
            if new.where("old <> root").isEmpty():
                sizes = labels.groupBy("root").agg(F.count("*").alias("size"))
                return labels.join(sizes, "root").select("node", "root", "size")
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
