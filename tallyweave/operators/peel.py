"""Peel shapes and chains.

A peel-shaped transaction leads to at most one other: the first spend of its
carrier. So walks live on a graph in which every node has one way on, and all
that is asked of them (lengths, which starts count, which start was the last
over a transaction) is found by doubling: after k rounds every transaction
knows what lies 2**k steps on, or what came to it from as far. Rounds shuffle
identifiers only, and no component, however large, is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.ledger import Ledger
from tallyweave.session import Scratch

MIN_CHAIN = 3
MAX_WALK = 500
RETAIN = 0.85


def shares(led: Ledger) -> DataFrame:
    """(txid, ord, n_out, total, biggest, carrier) over all outputs; the carrier is the first of the largest outputs."""
    return led.out.groupBy("txid").agg(
        F.first("ord").alias("ord"), F.count("*").alias("n_out"), F.sum("value").alias("total"), F.max("value").alias("biggest"), F.max_by("address", F.struct("value", -F.col("o_pos"))).alias("carrier")
    )


def _like(s: DataFrame) -> DataFrame:
    return s.where(F.col("n_out").between(2, 3) & (F.col("total") > 0)).where(F.col("biggest") / F.col("total") >= RETAIN)


def peel_shaped(led: Ledger) -> DataFrame:
    """Transactions of 2 or 3 outputs of which one takes at least 85 % but not all."""
    return _like(shares(led)).where("total > biggest")


def spent_by(led: Ledger) -> DataFrame:
    """(address, txid): the earliest transaction that spends from an address."""
    return led.inp.groupBy("address").agg(F.min_by("txid", "ord").alias("txid"))


def successors(led: Ledger) -> DataFrame:
    """(txid, ord, carrier, next): next is the carrier's first spend, if it is another peel-shaped transaction."""
    p = peel_shaped(led).select("txid", "ord", "carrier")
    nxt = spent_by(led).select(F.col("address").alias("carrier"), F.col("txid").alias("next"))
    shaped = p.select(F.col("txid").alias("next"))
    return p.join(nxt.join(shaped, "next", "left_semi"), "carrier", "left").select("txid", "ord", "carrier", F.when(F.col("next") != F.col("txid"), F.col("next")).alias("next"))


# --------------------------------------------------------------------------- doubling
def _onward(hop: DataFrame, scratch: Scratch, name: str = "hop") -> DataFrame:
    """(txid, far, n) twice as far: where that many steps lead, or null, and how many of them exist."""
    further = hop.select(F.col("txid").alias("far"), F.col("far").alias("_far"), F.col("n").alias("_n"))
    return scratch.keep(hop.join(further, "far", "left").select("txid", F.col("_far").alias("far"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")), name)


def _first_hop(steps: DataFrame, scratch: Scratch, name: str = "hop") -> DataFrame:
    return scratch.keep(steps.select("txid", F.col("next").alias("far"), F.when(F.col("next").isNotNull(), 1).otherwise(0).alias("n")), name)


def _walk_lengths(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """(txid, walk_length) of (txid, next). A walk ends where there is no next, before a repetition, or at ``MAX_WALK``."""
    hop = _first_hop(steps, scratch)
    length = F.least(F.col("n") + 1, F.lit(MAX_WALK)).alias("walk_length")
    left = hop.where("far is not null").count()
    while left:
        hop = _onward(hop, scratch)
        still = hop.where("far is not null").count()
        if still == left:
            break  # finite walks of all lengths up to the longest exist, so none is left: the others never end
        left = still
    ends = scratch.keep(hop.where("far is null").select("txid", length), "ends")
    if not left:
        return ends
    # rings: what is still reached when everything before a ring lies behind
    ringed = scratch.keep(steps.join(hop.where("far is not null").select("txid"), "txid", "left_semi"), "ringed")
    far = scratch.keep(hop.where("far is not null"), "far")
    on_ring = far.select("far").distinct().count()
    while True:
        far = _onward(far, scratch, "far")
        reached = far.select("far").distinct().count()
        if reached == on_ring:
            break
        on_ring = reached
    ring = scratch.keep(ringed.join(far.select(F.col("far").alias("txid")).distinct(), "txid", "left_semi"), "ring")
    # the smallest member names a ring; a round that changes nothing has seen it from everywhere
    low = scratch.keep(ring.select("txid", F.col("next").alias("far"), F.least("txid", "next").alias("low")), "low")
    while True:
        other = low.select(F.col("txid").alias("far"), F.col("far").alias("_far"), F.col("low").alias("_low"))
        new = scratch.keep(low.join(other, "far").select("txid", F.col("_far").alias("far"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("changed")), "lower")
        done = new.where("changed").isEmpty()
        low = scratch.keep(new.drop("changed"), "low")
        if done:
            break
    rings = scratch.keep(low.join(low.groupBy("low").agg(F.count("*").alias("size")), "low").select("txid", "size"), "rings")
    # steps up to the ring, then once around it
    tail = ringed.join(rings.select("txid", F.lit(True).alias("ring")), "txid", "left").select("txid", F.when(F.col("ring").isNull(), F.col("next")).alias("next"))
    stop = _first_hop(tail, scratch, "tail").withColumn("entry", F.coalesce("far", "txid"))
    stop = scratch.keep(stop, "stop")
    while not stop.where("far is not null").isEmpty():
        other = stop.select(F.col("txid").alias("far"), F.col("far").alias("_far"), F.col("n").alias("_n"), F.col("entry").alias("_entry"))
        stop = scratch.keep(stop.join(other, "far", "left").select("txid", F.col("_far").alias("far"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("_entry", "entry").alias("entry")), "stop")
    whole = stop.join(rings.select(F.col("txid").alias("entry"), "size"), "entry").select("txid", F.least(F.col("n") + F.col("size"), F.lit(MAX_WALK)).cast("int").alias("walk_length"))
    return scratch.keep(ends.unionByName(whole), "lengths")


def _spread(steps: DataFrame, values: DataFrame, reach: int, scratch: Scratch) -> DataFrame:
    """(txid, best): the largest value (ord, -steps from there, txid) within ``reach`` steps before a transaction, itself included.

    ``values`` has (txid, ord). Windows double; where ``reach`` is between two
    powers, the last two windows overlap, which a maximum may.
    """
    mark = F.struct(F.col("ord"), F.lit(0).alias("back"), F.col("txid").alias("start"))
    best = scratch.keep(steps.select("txid").join(values.select("txid", mark.alias("best")), "txid", "left"), "best")
    hop = _first_hop(steps, scratch)
    far_of_rest = scratch.keep(steps.select("txid", F.col("txid").alias("far")), "rest")

    def joined(best: DataFrame, hop: DataFrame, by: int) -> DataFrame:
        moved = F.when(F.col("best").isNotNull(), F.struct("best.ord", (F.col("best.back") - by).alias("back"), "best.start"))
        come = hop.where("far is not null").join(best.where("best is not null"), "txid").groupBy(F.col("far").alias("txid")).agg(F.max(moved).alias("come"))
        return scratch.keep(best.join(come, "txid", "left").select("txid", F.greatest("best", "come").alias("best")), "best")

    top = reach.bit_length() - 1
    for k in range(top):
        if (reach - (1 << top)) >> k & 1:
            own = hop.select(F.col("txid").alias("far"), F.col("far").alias("_far"))
            far_of_rest = scratch.keep(far_of_rest.join(own, "far", "left").select("txid", F.col("_far").alias("far")), "rest")
        best = joined(best, hop, 1 << k)
        if k + 1 < top:
            hop = _onward(hop, scratch)
    if reach > 1 << top:
        best = joined(best, far_of_rest, reach - (1 << top))
    return best


def _starts(s: DataFrame, lengths: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """(txid, ord) of the walks that count: long enough, and on no earlier walk that counts.

    A walk that could still count and comes first among all that lead to its
    start does count; what it goes through does not start. Where no walk is cut
    off at ``MAX_WALK``, walks go on through each other, so one round decides all.
    """
    reach = min(longest, MAX_WALK) - 1  # steps on from a start
    open_ = scratch.keep(lengths.where(F.col("walk_length") >= MIN_CHAIN).join(s.select("txid", "ord"), "txid").select("txid", "ord"), "open")
    # earliest before: the largest of reversed orders
    fields = [f.name for f in s.schema["ord"].dataType.fields]
    numeric = [F.struct(*[(-F.col(f"ord.{f}")).alias(f) if s.schema["ord"].dataType[f].dataType.typeName() in ("long", "integer", "short") else F.col(f"ord.{f}") for f in fields])]

    def earliest_before(values: DataFrame) -> DataFrame:
        back = _spread(s.select("txid", "next"), values.select("txid", numeric[0].alias("ord")), reach, scratch)
        come = back.where("best is not null").join(s.where("next is not null").select("txid", "next"), "txid").groupBy(F.col("next").alias("txid")).agg(F.max("best.ord").alias("first"))
        return scratch.keep(come, "before")

    starts = scratch.keep(open_.limit(0), "starts")
    while True:
        before = earliest_before(open_.unionByName(starts))
        both = open_.join(before, "txid", "left").withColumn("own", numeric[0])
        fresh = both.where("first is null or first <= own").select("txid", "ord")
        starts = scratch.keep(starts.unionByName(fresh), "starts_a")
        if longest < MAX_WALK:
            return starts
        taken = earliest_before(starts)
        rest = open_.join(starts.select("txid"), "txid", "left_anti").join(taken, "txid", "left").withColumn("own", numeric[0]).where("first is null or first <= own").select("txid", "ord")
        open_ = scratch.keep(rest, "open_a")
        if open_.isEmpty():
            return starts
        starts = scratch.keep(starts, "starts_b")
        open_ = scratch.keep(open_, "open_b")


# --------------------------------------------------------------------------- operators
def walk_lengths(led: Ledger) -> DataFrame:
    """(txid, walk_length): transactions on the walk from each peel-shaped one.

    Walks that run into a cycle count every transaction once; the cap is ``MAX_WALK``.
    """
    with Scratch(led.spark()) as scratch:
        scratch.hold("ends", "lengths")
        return _walk_lengths(scratch.keep(successors(led).select("txid", "next"), "steps"), scratch)


def chain_members(led: Ledger) -> DataFrame:
    """(address, chain_length, position) of the carriers on chains of at least three transactions.

    In stream order each transaction starts a walk unless an earlier long enough
    walk went through it; walks go on through such transactions; of several
    walks over a carrier the last one counts. No chains give no rows.
    """
    with Scratch(led.spark()) as scratch:
        scratch.hold("members")
        s = scratch.keep(successors(led), "successors")
        lengths = scratch.keep(_walk_lengths(s.select("txid", "next"), scratch), "lengths_all")
        longest = lengths.agg(F.max("walk_length")).first()[0] or 0
        if longest < MIN_CHAIN:
            return scratch.keep(s.select(F.col("carrier").alias("address"), F.lit(0).alias("chain_length"), F.lit(0).alias("position")).limit(0), "members")
        starts = _starts(s, lengths, longest, scratch)
        last = _spread(s.select("txid", "next"), starts, min(longest, MAX_WALK), scratch).where("best is not null")
        over = last.select("txid", F.col("best.ord").alias("began"), F.col("best.start").alias("start"), (1 - F.col("best.back")).alias("position"))
        over = over.join(s.select("txid", "carrier"), "txid").join(lengths.select(F.col("txid").alias("start"), F.col("walk_length").alias("chain_length")), "start")
        best = over.groupBy(F.col("carrier").alias("address")).agg(F.max_by(F.struct("chain_length", "position"), F.struct("began", "position")).alias("m"))
        return scratch.keep(best.select("address", F.col("m.chain_length").cast("int").alias("chain_length"), F.col("m.position").cast("int").alias("position")), "members")


def peel_columns(led: Ledger, members: DataFrame) -> DataFrame:
    """(address, peel_chain_length, peel_like_spends) of members that spend."""
    like = _like(shares(led)).select("txid", F.lit(1).alias("like"))
    return (
        led.inp.join(members.select("address", "chain_length"), "address").join(like, "txid", "left")
        .groupBy("address").agg(F.max("chain_length").alias("peel_chain_length"), F.count("like").alias("peel_like_spends"))
    )
