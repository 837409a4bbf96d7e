"""Transactions as flat inputs and outputs, in stream order.

``ord`` is the total order of the stream: (time, height, place), where a missing
time (0) is replaced by the block's. Structs compare member by member, so no
global numbering is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import Scratch
from tallyweave.sources.tables import table


@dataclass
class Ledger:
    """inp(txid, ts, ord, i_pos, address, value) and out(txid, ts, ord, o_pos, address, value).

    ``txs`` has one row per transaction: txid, ts, ord, height.
    """

    txs: DataFrame
    inp: DataFrame
    out: DataFrame

    def spark(self) -> SparkSession:
        return self.txs.sparkSession

    def stored(self) -> Ledger:
        """The same ledger, flattened and written once, for operators that read it many times."""
        with Scratch(self.spark()) as scratch:
            scratch.hold("txs", "inp", "out")
            return Ledger(scratch.keep(self.txs, "txs"), scratch.keep(self.inp, "inp"), scratch.keep(self.out, "out"))


def from_blocks(blocks: DataFrame) -> Ledger:
    """From reduced blocks (height, time, txs[txid, time, inputs, outputs]).

    Inputs and outputs without address are dropped, and transactions without
    either. Places count what is left, in its order.
    """
    t = blocks.select("height", F.col("time").alias("block_time"), F.posexplode("txs").alias("tx_pos", "t"))
    keep = lambda c: F.filter(F.coalesce(F.col(f"t.{c}"), F.array()), lambda e: e["address"].isNotNull())
    ts = F.coalesce(F.when(F.col("t.time") != 0, F.col("t.time")), "block_time")
    t = t.select(
        F.col("t.txid").alias("txid"), ts.alias("ts"), F.struct(ts.alias("ts"), "height", "tx_pos").alias("ord"), "height", keep("inputs").alias("i"), keep("outputs").alias("o")
    ).where("size(i) > 0 or size(o) > 0")
    head = ["txid", "ts", "ord"]
    inp = t.select(*head, F.posexplode("i").alias("i_pos", "e")).select(*head, "i_pos", F.col("e.address").alias("address"), F.col("e.value_sats").alias("value"))
    out = t.select(*head, F.posexplode("o").alias("o_pos", "e")).select(*head, "o_pos", F.col("e.address").alias("address"), F.col("e.value_sats").alias("value"))
    return Ledger(t.select(*head, "height"), inp, out)


def blocks_of_tx(tx: DataFrame) -> DataFrame:
    """Reduced blocks of the confirmed rows of a transaction table, transactions in order of their identifier; missing values are 0."""

    def side(c: str) -> Column:
        named = F.filter(F.coalesce(F.col(c), F.array()), lambda e: e["address"].isNotNull() & (e["address"] != ""))
        return F.transform(named, lambda e: e.withField("value_sats", F.coalesce(e["value_sats"], F.lit(0))))

    one = F.struct("txid", F.coalesce("time", F.lit(0)).alias("time"), side("inputs").alias("inputs"), side("outputs").alias("outputs"))
    return tx.where("block_height is not null and txid is not null").groupBy(F.col("block_height").alias("height")).agg(
        F.max("time").alias("time"), F.sort_array(F.collect_list(one)).alias("txs")
    )


def from_orders(spark: SparkSession, folder: str) -> Ledger:
    """Orders as transactions: the customer pays the kept line items' addresses."""
    n = table(spark, folder, "customer").agg(F.count("*").alias("n"))
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("txid"), day.alias("height"), (day * 86400 + F.col("o_orderkey") % 86400).alias("ts"), "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v")
    )
    txs = o.select("txid", "ts", F.struct("ts", "height", "txid").alias("ord"), "height")
    inp = o.select("txid", "ts", F.struct("ts", "height", "txid").alias("ord"), F.lit(0).alias("i_pos"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("address"), F.col("v").alias("value"))
    # line numbers repeat within an order: the place is an ordered pair of numbers in one
    pos = F.col("l_linenumber") * F.lit(1 << 40) + F.col("l_partkey") * F.lit(1 << 18) + F.col("l_suppkey")
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    payee = F.when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).otherwise(
        F.concat(F.lit("c"), ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber")) % F.col("n")).cast("string"))
    )
    lines = (
        table(spark, folder, "lineitem").where("l_tax < 0.04").crossJoin(F.broadcast(n))  # one row: the number of customers
        .select(F.col("l_orderkey").alias("txid"), pos.cast("long").alias("o_pos"), payee.alias("address"), F.when(F.col("l_discount") >= 0.05, F.expr("cast(round(l_extendedprice * 100) as bigint) div 50")).otherwise(price).alias("value"))
    )
    out = lines.join(txs.select("txid", "ts", "ord"), "txid").select("txid", "ts", "ord", "o_pos", "address", "value")
    return Ledger(txs, inp, out)


def height_window(blocks: DataFrame, days: float | None = None, count: int | None = None, end: int | None = None) -> DataFrame:
    """The last ``count`` (or ``days`` of 144) heights up to ``end``; without ``end``, up to the highest."""
    count = count or int(days * 144 + 0.5)
    if end is None:
        end = blocks.agg(F.max("height")).first()[0]
        if end is None:
            return blocks.limit(0)
    return blocks.where(F.col("height").between(max(0, end - count + 1), end))
