"""Behaviour of addresses within a window of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions.money import SATS, round_half_up
from tallyweave.operators.ledger import Ledger
from tallyweave.operators.ranks import ranged
from tallyweave.session import Scratch

FAST_SPLIT_SECONDS = 600
# Feature names in document order. Fixed values.
FEATURES = (
    "avg_holding_time", "number_of_splits", "percentage_sent_to_new_addresses", "transaction_frequency", "n_tx_in", "n_tx_out", "in_degree", "out_degree",
    "received_btc", "sent_btc", "balance_btc", "forward_ratio", "lifetime_seconds", "peel_like_spends", "peel_chain_length", "largest_received_btc",
    "layering_score", "collector_score", "peel_score",
)
CLUSTER_FEATURES = FEATURES[:4]


def ext_out(led: Ledger) -> DataFrame:
    """Outputs that are no change: their address is in none of the transaction's inputs."""
    return led.out.join(led.inp.select("txid", "address").distinct(), ["txid", "address"], "left_anti")


def first_seen(led: Ledger) -> DataFrame:
    """(address, first_seen) over inputs and all outputs."""
    return led.inp.select("address", "ts").unionByName(led.out.select("address", "ts")).groupBy("address").agg(F.min("ts").alias("first_seen"))


def receipts(ext: DataFrame) -> DataFrame:
    return ext.groupBy("address").agg(
        F.count("*").alias("n_tx_in"), F.sum("value").alias("received_sats"), F.max("value").alias("largest_received_sats"), F.max("ts").alias("last_in")
    )


def spends(led: Ledger) -> DataFrame:
    return led.inp.groupBy("address").agg(F.count("*").alias("n_tx_out"), F.sum("value").alias("sent_sats"), F.max("ts").alias("last_out"))


def payments(led: Ledger, ext: DataFrame, first: DataFrame) -> DataFrame:
    """(address, max_split_width, paid_to_total, paid_to_new); each input row counts its transaction's payments."""
    per_tx = ext.join(first, "address").groupBy("txid").agg(F.count("*").alias("w"), F.count_if(F.col("first_seen") >= F.col("ts")).alias("w_new"))
    return led.inp.join(per_tx, "txid").groupBy("address").agg(
        F.max("w").alias("max_split_width"), F.sum("w").alias("paid_to_total"), F.sum("w_new").alias("paid_to_new")
    )


def counterparties(led: Ledger, ext: DataFrame) -> DataFrame:
    """Distinct (src, dst). Repetitions within a transaction go before pairs are formed."""
    a = led.inp.select("txid", F.col("address").alias("src")).distinct()
    b = ext.select("txid", F.col("address").alias("dst")).distinct()
    return a.join(b, "txid").select("src", "dst").distinct()


def degrees(pairs: DataFrame) -> DataFrame:
    """(address, in_degree, out_degree), exact."""
    both = pairs.select(F.col("dst").alias("address"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(pairs.select(F.col("src").alias("address"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.groupBy("address").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def turnaround(led: Ledger, ext: DataFrame) -> DataFrame:
    """(address, fastest_turnaround): the smallest gap between a spend and the last receipt before it.

    The as-of step runs within ranges of (address, order), so an address with a
    third of all rows is spread over a third of the ranges, however its rows lie
    in time; what a range leaves to later ones of its address is one row.
    """
    got = ext.select("address", "ord", "ts", F.col("ts").alias("got"))
    gave = led.inp.select("address", "ord", "ts", F.lit(None).cast("long").alias("got"))
    with Scratch(led.spark()) as scratch:
        rows = ranged(got.unionByName(gave), [F.col("address"), F.col("ord")], scratch, "turns")
        before = W.partitionBy("part", "address").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
        near = rows.withColumn("near", F.last("got", ignorenulls=True).over(before)).where("got is null")
        ends = rows.groupBy("address", "part").agg(F.max("got").alias("end"))
        earlier = W.partitionBy("address").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select("address", "part", F.last("end", ignorenulls=True).over(earlier).alias("far")).where("far is not null")
        gaps = near.join(carried, ["address", "part"], "left").select("address", (F.col("ts") - F.coalesce("near", "far")).alias("gap"))
        return gaps.where("gap >= 0").groupBy("address").agg(F.min("gap").alias("fastest_turnaround"))


def accumulators(led: Ledger) -> DataFrame:
    """One row per address with all counters. The change-free outputs, which four of them read, are joined and written once."""
    with Scratch(led.spark()) as scratch:
        scratch.hold("ext")
        ext, first = scratch.keep(ext_out(led), "ext"), first_seen(led)
    all_ = receipts(ext).join(spends(led), "address", "full").join(first, "address", "left").join(payments(led, ext, first), "address", "left")
    all_ = all_.join(degrees(counterparties(led, ext)), "address", "left").join(turnaround(led, ext), "address", "left")
    counts = ("n_tx_in", "n_tx_out", "received_sats", "sent_sats", "largest_received_sats", "max_split_width", "paid_to_total", "paid_to_new", "in_degree", "out_degree")
    return all_.select(
        "address", "first_seen", F.greatest("last_in", "last_out").alias("last_seen"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "fastest_turnaround"
    )


def with_features(acc: DataFrame, peel: DataFrame | None = None, min_txs: int = 2) -> DataFrame:
    """address, first_seen, last_seen and the 19 features, of addresses with at least ``min_txs`` inputs and outputs.

    ``peel`` has (address, peel_chain_length, peel_like_spends); without it both are 0.
    """
    acc = acc.where(F.col("n_tx_in") + F.col("n_tx_out") >= min_txs)
    if peel is None:
        acc = acc.withColumns({"peel_chain_length": F.lit(0), "peel_like_spends": F.lit(0)})
    else:
        acc = acc.join(peel, "address", "left").fillna(0, ["peel_chain_length", "peel_like_spends"])
    c = F.col
    n = c("n_tx_in") + c("n_tx_out")
    lifetime = F.greatest(F.lit(0), c("last_seen") - c("first_seen"))
    hold = F.coalesce(c("fastest_turnaround"), lifetime)
    capped = lambda x: F.least(F.lit(1.0), x)
    zero = F.lit(0.0)
    f: dict[str, Column] = {
        "avg_holding_time": hold,
        "number_of_splits": c("max_split_width"),
        "percentage_sent_to_new_addresses": F.when(c("paid_to_total") > 0, c("paid_to_new") / c("paid_to_total")).otherwise(zero),
        "transaction_frequency": F.when(lifetime > 0, n / (lifetime / F.lit(3600.0))).otherwise(n),
        "n_tx_in": c("n_tx_in"),
        "n_tx_out": c("n_tx_out"),
        "in_degree": c("in_degree"),
        "out_degree": c("out_degree"),
        "received_btc": c("received_sats") / F.lit(float(SATS)),
        "sent_btc": c("sent_sats") / F.lit(float(SATS)),
        "balance_btc": (c("received_sats") - c("sent_sats")) / F.lit(float(SATS)),
        "forward_ratio": F.when(c("received_sats") > 0, capped(c("sent_sats") / c("received_sats"))).otherwise(zero),
        "lifetime_seconds": lifetime,
        "peel_like_spends": c("peel_like_spends"),
        "peel_chain_length": c("peel_chain_length"),
        "largest_received_btc": c("largest_received_sats") / F.lit(float(SATS)),
        "layering_score": F.when(
            (c("max_split_width") >= 4) & (hold <= FAST_SPLIT_SECONDS) & (c("received_sats") > 0), capped(c("max_split_width") / 10 * (1 - hold / FAST_SPLIT_SECONDS))
        ).otherwise(zero),
        "collector_score": F.when((c("in_degree") >= 8) & (c("out_degree") <= 2) & (c("received_sats") > 0), capped(c("in_degree") / 40)).otherwise(zero),
        "peel_score": F.when(c("peel_chain_length") >= 3, capped(c("peel_chain_length") / 10)).otherwise(zero),
    }
    return acc.select("address", "first_seen", "last_seen", *[f[k].cast("double").alias(k) for k in FEATURES])


def pattern_counts(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count_if(F.col("layering_score") > 0).alias("layering"),
        F.count_if(F.col("collector_score") > 0).alias("collector"),
        F.count_if((F.col("peel_score") > 0.5) & (F.col("n_tx_out") >= 2)).alias("peeling"),
        F.count_if((F.col("forward_ratio") > 0.95) & (F.col("received_btc") > 0.01)).alias("pass_through"),
    )


def window_stats(led: Ledger, features: DataFrame) -> DataFrame:
    seen = first_seen(led).agg(F.count("*").alias("distinct_addresses"))
    t = led.txs.agg(F.count("*").alias("transactions"), F.min("ts").alias("window_start"), F.max("ts").alias("window_end"), F.count_distinct("height").alias("blocks"))
    rows = features.agg(F.count("*").alias("addresses_with_min_activity"))
    return t.crossJoin(seen).crossJoin(rows)  # one row each


def edges(led: Ledger, analysed: DataFrame) -> DataFrame:
    """(src, dst, value_sats, n_txs, first_time) between analysed addresses; value is shared out by the inputs' part."""
    keep = analysed.select("address")
    total = led.inp.groupBy("txid").agg(F.sum("value").alias("total_in")).where("total_in > 0")
    i = led.inp.join(total, "txid").join(keep, "address", "left_semi").select("txid", F.col("address").alias("src"), (F.col("value") / F.col("total_in")).alias("share"))
    o = ext_out(led).join(keep, "address", "left_semi").select("txid", "ts", "ord", F.col("address").alias("dst"), "value")
    by_block = F.struct(F.col("ord.height"), F.col("ord"))
    return (
        i.join(o, "txid").where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.sum(round_half_up(F.col("value") * F.col("share"))).alias("value_sats"), F.count("*").alias("n_txs"), F.min_by("ts", by_block).alias("first_time"))
    )
