"""Exactly one copy of messages that were delivered at least once.

Identifiers are split by their aggregated frequency. The frequencies are counted
over 64-bit hashes, with partial counts in each task, so an identifier with a
third of all rows sends one number per task. The hashes that occur more than
once are put into a bit table of at most ``2 ** _MAX_BITS`` bits, which bounds
the one thing that is broadcast. A row whose bit is not set is a singleton for
sure and passes where it lies: it is neither shuffled nor sorted. Only rows whose
bit is set are ranked within their identifier, by aggregates that are combined
in each task. A singleton that meets a set bit is ranked as a group of one,
so the result is exact however full the table gets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import Scratch

_MAX_BITS = 28  # 2**28 bits are 32 MB
_BITS_PER_ID = 16
_WORDS = 64  # of 64 bits, in each broadcast row


def message_id(column: str = "txid") -> Column:
    """Identifier without surrounding blanks and letter case; null where there is none."""
    t = F.lower(F.trim(F.col(column)))
    return F.when(t != "", t)


# --------------------------------------------------------------------------- split by frequency
@dataclass
class Split:
    """``single``: rows whose identifier certainly occurs once, or that have none. ``repeated``: all others. Both with ``_id``."""

    single: DataFrame
    repeated: DataFrame


def _bit_table(hashes: DataFrame, bits: int) -> DataFrame:
    """(block, words): the bits of all hashes, 64 words of 64 bits a row."""
    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = hashes.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(one).alias("word"))
    block = words.groupBy(F.shiftright("at", 6).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("at").bitwiseAND(F.lit(_WORDS - 1)).cast("int"), "word"))).alias("m"))
    # at most 64 entries a block
    return block.select("block", F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def split_by_frequency(rows: DataFrame, scratch: Scratch, id_column: str = "_id") -> Split:
    """Split rows by how often their identifier occurs; rows of ``repeated`` are those with a set bit."""
    h = F.xxhash64(id_column)
    named = rows.where(F.col(id_column).isNotNull())
    twice = scratch.keep(named.select(h.alias("h")).groupBy("h").count().where("count > 1").select("h"), "twice")
    bits = min(_MAX_BITS, max(12, (_BITS_PER_ID * twice.count()).bit_length()))
    table = F.broadcast(scratch.keep(_bit_table(twice, bits), "bits"))  # 2**(bits - 12) rows of 64 words at most
    scratch.drop("twice")
    scratch.hold("bits")
    at = h.bitwiseAND(F.lit((1 << bits) - 1))
    hit = F.expr("coalesce(shiftright(words[cast(shiftright(_at, 6) & 63 as int)], cast(_at & 63 as int)) & 1L, 0L) = 1")
    flagged = rows.withColumn("_at", F.when(F.col(id_column).isNotNull(), at)).join(table, F.shiftright("_at", 12) == F.col("block"), "left").withColumn("_hit", hit)
    own = [F.col(f"`{c}`") for c in rows.columns]
    return Split(flagged.where("not _hit").select(*own), flagged.where("_hit").select(*own))


# --------------------------------------------------------------------------- operators
def exactly_once(df: DataFrame, id_column: str = "txid", order: str = "delivery_id", stored: DataFrame | None = None) -> DataFrame:
    """All rows of ``stored`` and ``df`` with one row per identifier: the one of the smallest ``order``.

    Rows whose identifier occurs once, and rows without identifier, pass through
    as they are; only repeated groups are ranked, and both results are united.
    Rows that tie in ``order`` are ranked by their content's hash, and of equal
    rows one remains; a null ``order`` ranks last. Columns that ``stored`` or
    ``df`` lack are null. An empty table gives no rows.
    """
    if stored is not None:
        df = stored.unionByName(df, allowMissingColumns=True)
    columns = df.columns
    packed = df.select(message_id(id_column).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    with Scratch(df.sparkSession) as scratch:
        parts = split_by_frequency(packed, scratch)
        key = F.col(f"_row.`{order}`")
        rank = F.struct(key.isNull(), key, F.xxhash64(F.to_json("_row")))
        ranked = parts.repeated.groupBy("_id").agg(F.min_by("_row", rank).alias("_row"))
        both = parts.single.select("_row").unionByName(ranked.select("_row"))
        return both.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def surplus_pairs(df: DataFrame, id_column: str = "txid", order: str = "delivery_id", hot_share: float = 0.001) -> DataFrame:
    """(first_<order>, <order>) for every row that ``exactly_once`` leaves out.

    The split is that of ``exactly_once``: singletons need no look, and repeated
    groups are ranked by ``order``. Rows without identifier have no copies.
    Repeated rows with equal ``order`` count as the same delivery and are no
    surplus of themselves; rows without ``order`` name no delivery and give
    none. An empty table gives no rows; other columns of ``df`` are not read.

    The rows meet the first of their group by a join. An identifier is hot if it
    has at least ``hot_share`` of the repeated rows, so there are at most
    1 / hot_share hot ones, which bounds their broadcast; the largest key of the
    shuffle join for all others is below that share.
    """
    rows = df.select(message_id(id_column).alias("_id"), F.col(f"`{order}`").alias("_order"))
    with Scratch(df.sparkSession) as scratch:
        repeated = scratch.keep(split_by_frequency(rows, scratch).repeated, "repeated")
        groups = scratch.keep(repeated.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_first")).where("_n > 1 and _first is not null"), "groups")
        scratch.drop("bits")
        scratch.hold("repeated", "groups")
        limit = max(1000, int((groups.agg(F.sum("_n")).first()[0] or 0) * hot_share))
        hot = groups.where(F.col("_n") >= limit).select("_id", F.col("_first").alias("_hot")).limit(int(1 / hot_share) + 1)
        cold = groups.where(F.col("_n") < limit).select("_id", "_first")
        flagged = repeated.join(F.broadcast(hot), "_id", "left")
        pairs = flagged.where("_hot is not null").select(F.col("_hot").alias("_first"), "_order").unionByName(
            flagged.where("_hot is null").join(cold, "_id").select("_first", "_order")
        )
        return pairs.where("_order <> _first").select(F.col("_first").alias(f"first_{order}"), F.col("_order").alias(order))
