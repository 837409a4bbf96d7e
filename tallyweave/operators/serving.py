"""The window's views: overview, ranking, address, graph and cluster lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import graph
from tallyweave.operators.behavior import FEATURES

def exit_kind() -> Column:
    """'service' by degrees, else 'dormant' if received and never spent, else null."""
    return F.when((F.col("in_degree") >= 40) & (F.col("out_degree") >= 40), "service").when((F.col("received_btc") > 0.01) & (F.col("n_tx_out") == 0), "dormant")


def exits(features: DataFrame) -> DataFrame:
    return features.select("address", exit_kind().alias("exit_kind"), "received_btc", "in_degree", "out_degree").where("exit_kind is not null")


def tags() -> Column:
    """Tags of the serving view: peel chains by length."""
    n = F.col("peel_chain_length")
    return F.array_compact(
        F.array(
            F.when(F.col("layering_score") > 0.1, "layering"),
            F.when(F.col("collector_score") > 0.1, "fan-in"),
            F.when(n >= 3, F.concat(F.lit("peel x"), F.floor(n + 0.5).cast("string"))),
            F.when(F.col("forward_ratio") > 0.95, "pass-through"),
        )
    )


def report_tags() -> Column:
    """Tags of the console report: peeling by score."""
    return F.array_compact(
        F.array(
            F.when(F.col("layering_score") > 0.1, "layering"),
            F.when(F.col("collector_score") > 0.1, "fan-in"),
            F.when(F.col("peel_score") > 0.5, "peeling"),
            F.when(F.col("forward_ratio") > 0.95, "pass-through"),
        )
    )


def ranking(ranked: DataFrame, min_btc: float = 0.0, limit: int = 60, pattern: str = "all") -> DataFrame:
    keep = {"layering": F.col("layering_score") > 0.1, "fanin": F.col("collector_score") > 0.1, "peel": F.col("peel_chain_length") >= 3}.get(pattern, F.lit(True))
    return ranked.where((F.col("received_btc") >= min_btc) & keep).withColumn("tags", tags()).orderBy("rank").limit(min(300, limit))


def clusters(risk: DataFrame, limit: int = 50) -> DataFrame:
    return risk.where("not is_noise and size >= 3").orderBy(F.col("risk").desc(), F.col("size").desc(), "cluster").limit(limit)


def address_view(features: DataFrame, ranked: DataFrame, clusters: DataFrame, risk: DataFrame) -> DataFrame:
    """Every address with rank, score, cluster and its risk, and exit kind; filter by address for one."""
    r = ranked.select("address", "rank", "score")
    c = clusters.select("address", "cluster").join(risk.select("cluster", "risk"), "cluster", "left")
    return features.withColumn("exit_kind", exit_kind()).join(r, "address", "left").join(c, "address", "left")


def overview(stats: DataFrame, patterns: DataFrame, edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: statistics, pattern counts, edges and the hours between the first and the last block (``blocks`` has time)."""
    hours = blocks.agg(F.round((F.max("time") - F.min("time")) / 3600, 1).alias("hours"))
    return stats.crossJoin(patterns).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(hours)  # one row each


def counterparties(features: DataFrame, edges: DataFrame, k: int = 30) -> DataFrame:
    """(address, dir, pos, other, value_sats, exit_kind): the k largest of every address and direction, with what the other one is."""
    top = graph.top_counterparties(graph.adjacency(edges), k)
    kinds = features.select(F.col("address").alias("other"), exit_kind().alias("exit_kind"))
    return top.join(kinds, "other", "left").select("address", "dir", "pos", "other", "value_sats", "exit_kind")


def high_risk(risk: DataFrame, k: int = 6) -> DataFrame:
    """The k riskiest cohorts of at least five members."""
    return risk.where("not is_noise and size >= 5").orderBy(F.col("risk").desc(), "cluster").limit(k)


def graph_view(features: DataFrame, edges: DataFrame, ranked: DataFrame, seed: str, hops: int = 2, max_nodes: int = 160) -> dict[str, DataFrame]:
    """Nodes around a seed with score and exit kind, the edges among them, and the exits by what they received.

    At most ``max_nodes`` (500) nodes; a seed outside the window gives itself only.
    """
    near = graph.ego_network(graph.adjacency(edges), seed, hops, max_nodes)
    scores = ranked.select("address", "score")
    nodes = (
        near.join(features, "address").join(scores, "address", "left")
        .select("address", "hops", (F.col("hops") == 0).alias("is_seed"), exit_kind().alias("exit_kind"), F.coalesce("score", F.lit(0.0)).alias("score"), "received_btc", "balance_btc", "in_degree", "out_degree")
    )
    return {"nodes": nodes, "edges": graph.induced_edges(edges, near), "exits": nodes.where("exit_kind is not null").orderBy(F.col("received_btc").desc(), "address")}


def feature_map(features: DataFrame) -> DataFrame:
    """(address, features): the 19 features as a map by name."""
    return features.select("address", F.map_from_arrays(F.array(*map(F.lit, FEATURES)), F.array(*FEATURES)).alias("features"))


def score_tier(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def window_estimate(days: Column) -> tuple[Column, Column]:
    """(blocks, minutes) that a window of so many days takes to fetch."""
    blocks = F.floor(days * 144 + 0.5)
    return blocks, F.floor(blocks * 6 / 60 + 0.5)


def tx_parties(tx: DataFrame) -> DataFrame:
    """Per row the addresses of both sides, and what each got and spent: (delivery_id, address, received, spent)."""
    one = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda e: F.struct(e["address"].alias("a"), F.coalesce(e["value_sats"], F.lit(0)).alias("v"), F.lit(c == "outputs").alias("got")))
    e = tx.select("delivery_id", F.explode(F.concat(one("inputs"), one("outputs"))).alias("e")).where("e.a <> ''")
    return e.groupBy("delivery_id", F.col("e.a").alias("address")).agg(F.sum(F.when(F.col("e.got"), F.col("e.v")).otherwise(0)).alias("received"), F.sum(F.when(~F.col("e.got"), F.col("e.v")).otherwise(0)).alias("spent"))
