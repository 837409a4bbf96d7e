"""Streaming forms of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators.delivery import message_id


def exactly_once_stream(stream: DataFrame, id_column: str = "txid", time_column: str = "delivered_at", lateness: str = "7 days") -> DataFrame:
    """One row per identifier among the rows that come within ``lateness`` of each other.

    Rows without identifier pass. The state holds identifiers of that time only;
    a copy that comes later is let through and caught by ``delivery.exactly_once``
    over the stored table.
    """
    named = stream.withColumn("_id", message_id(id_column)).withWatermark(time_column, lateness)
    some = named.where("_id is not null").dropDuplicatesWithinWatermark(["_id"])
    return some.unionByName(named.where("_id is null")).drop("_id")


def activity_stream(stream: DataFrame, time_column: str = "delivered_at", slot: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Per address and time slot: inputs, outputs, sent and received, closed when the watermark passes the slot."""
    side = lambda c, s: F.transform(F.coalesce(F.col(c), F.array()), lambda e: F.struct(F.lit(s).alias("side"), e["address"].alias("address"), F.coalesce(e["value_sats"], F.lit(0)).alias("value")))
    e = stream.withWatermark(time_column, lateness).select(time_column, F.explode(F.concat(side("inputs", "in"), side("outputs", "out"))).alias("e")).where("e.address <> ''")
    is_in = F.col("e.side") == "in"
    return (
        e.groupBy(F.window(time_column, slot).alias("slot"), F.col("e.address").alias("address"))
        .agg(
            F.count_if(is_in).alias("n_inputs"),
            F.count_if(~is_in).alias("n_outputs"),
            F.sum(F.when(is_in, F.col("e.value")).otherwise(0)).alias("sent_sats"),
            F.sum(F.when(~is_in, F.col("e.value")).otherwise(0)).alias("received_sats"),
        )
        .select(F.col("slot.start").alias("slot_start"), "address", "n_inputs", "n_outputs", "sent_sats", "received_sats")
    )


def append_partials(stream: DataFrame, partials, path: str, checkpoint: str) -> StreamingQuery:
    """Write mergeable partial results of every micro-batch.

    ``partials`` maps a batch to rows that can be merged later (sums, hash runs,
    summaries). Each batch overwrites its own folder, so a repeated batch after
    a failure counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        partials(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
