"""Reduced blocks and window documents as tables.

Blocks lie in one folder partitioned by ``shard`` (height div 1000), so a height
range reads its shards only. Writes go through Spark's file committer, which
makes them atomic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.nested import IN_NAMES, OUT_NAMES, as_list, unwrap_bodies

SHARD = 1000
# The closed set of places a record may come from. Fixed values.
SOURCES = ("blockchain.info", "bitcoin-core-rpc", "csv-import", "json-import", "jsonl-import", "parquet-import")
BLOCK_SCHEMA = (
    "height long, hash string, time long, n_tx long, txs array<struct<txid: string, time: long, inputs: array<struct<address: string, value_sats: long>>, "
    "outputs: array<struct<n: int, address: string, value_sats: long>>>>"
)


def read_blocks_json(spark: SparkSession, path: str) -> DataFrame:
    """All block files below a folder; broken files are left out as if absent."""
    return spark.read.schema(BLOCK_SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").json(path).where("height is not null")


def reduce_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks without unaddressed inputs and outputs, and without transactions that have neither; n_tx keeps the number before."""
    keep = lambda t, c: F.filter(F.coalesce(t[c], F.array()), lambda e: e["address"].isNotNull())
    txs = F.transform(F.coalesce("txs", F.array()), lambda t: F.struct(t["txid"].alias("txid"), t["time"].alias("time"), keep(t, "inputs").alias("inputs"), keep(t, "outputs").alias("outputs")))
    kept = F.filter(txs, lambda t: (F.size(t["inputs"]) > 0) | (F.size(t["outputs"]) > 0))
    out = blocks.withColumn("_kept", kept)
    return out.select("height", "hash", "time", F.coalesce("n_tx", F.size("_kept")).cast("long").alias("n_tx"), F.size("_kept").cast("long").alias("n_tx_kept"), F.col("_kept").alias("txs"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    blocks.withColumn("shard", F.floor(F.col("height") / SHARD).cast("int")).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_blocks(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Stored blocks of a height range; only the range's shards are read."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col("shard") >= start // SHARD) & (F.col("height") >= start))
    if end is not None:
        df = df.where((F.col("shard") <= end // SHARD) & (F.col("height") <= end))
    return df.drop("shard")


def tip_height(blocks: DataFrame) -> int | None:
    return blocks.agg(F.max("height")).first()[0]


def write_window(features: DataFrame, edges: DataFrame, stats: DataFrame, path: str) -> None:
    """A window document: its address rows, edges and one row of statistics."""
    features.write.mode("overwrite").parquet(f"{path}/features")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    stats.withColumn("built_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/meta")


def read_window(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a window document; non-finite features become 0."""
    features = spark.read.parquet(f"{path}/features")
    fix = {c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c)) for c, t in features.dtypes if t == "double"}
    return {"features": features.withColumns(fix), "edges": spark.read.parquet(f"{path}/edges"), "meta": spark.read.parquet(f"{path}/meta")}


# --------------------------------------------------------------------------- explorer responses
def provenance(source: str, **extras: str) -> Column:
    """The stamp of a record; an unknown source raises."""
    if source not in SOURCES:
        raise ValueError(f"unknown source: {source}")
    return F.struct(
        F.lit(source).alias("source"), F.lit(True).alias("is_real"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingested_at"), F.lit(False).alias("raw_available"),
        F.lit(",".join(f"{k}={v}" for k, v in sorted(extras.items())) or None).cast("string").alias("extras"),
    )


def require_real(df: DataFrame) -> DataFrame:
    """The rows themselves; any row without real provenance or transaction identifier stops the query."""
    ok = F.coalesce(F.col("provenance.is_real"), F.lit(False)) & F.col("provenance.source").isin(*SOURCES) & (F.coalesce("txid", F.lit("")) != "")
    return df.withColumn("txid", F.when(ok, F.col("txid")).otherwise(F.raise_error(F.lit("record without real provenance or transaction identifier")).cast("string")))


def canonical_transactions(raw: DataFrame, source: str = "json-import") -> DataFrame:
    """Canonical transactions of raw explorer responses, whatever the members are called.

    fee is 0 for coinbase transactions (no addressed inputs), else what inputs
    exceed outputs by. Null list elements are dropped, missing values count as 0.
    """
    t = F.col("tx")
    text = lambda e, *ps: F.coalesce(*[F.try_variant_get(e, p, "string") for p in ps])
    whole = lambda e, *ps: F.coalesce(*[F.try_variant_get(e, p, "bigint") for p in ps])
    real = lambda a: F.filter(F.coalesce(a, F.array().cast("array<variant>")), lambda e: e.isNotNull() & ~F.is_variant_null(e))
    lists = lambda names: real(F.coalesce(*[as_list(t, f"$.{n}") for n in names]))
    inputs = F.transform(
        lists(IN_NAMES),
        lambda e: F.struct(
            text(e, "$.address", "$.prevout.scriptpubkey_address", "$.prev_out.addr").alias("address"),
            F.coalesce(whole(e, "$.value_sats", "$.prevout.value", "$.prev_out.value"), F.lit(0)).alias("value_sats"),
            text(e, "$.txid").alias("prev_txid"),
            whole(e, "$.vout", "$.prev_out.n").cast("int").alias("prev_vout"),
        ),
    )
    outputs = F.transform(
        lists(OUT_NAMES),
        lambda e, i: F.struct(
            F.coalesce(whole(e, "$.n").cast("int"), i).alias("n"),
            text(e, "$.address", "$.scriptpubkey_address", "$.addr").alias("address"),
            F.coalesce(whole(e, "$.value_sats", "$.value"), F.lit(0)).alias("value_sats"),
            F.try_variant_get(e, "$.spent", "boolean").alias("spent"),
        ),
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, e: a + e["value_sats"])
    base = unwrap_bodies(raw).select(
        "record_id", "tx_pos", text(t, "$.txid", "$.hash").alias("txid"), whole(t, "$.block_height", "$.status.block_height").alias("block_height"),
        F.coalesce(whole(t, "$.time", "$.status.block_time"), F.lit(0)).alias("time"), inputs.alias("inputs"), outputs.alias("outputs"),
    )
    coinbase = F.size(F.filter("inputs", lambda e: e["address"].isNotNull())) == 0
    i, o = total(F.col("inputs")), total(F.col("outputs"))
    return base.select(
        "*", coinbase.alias("is_coinbase"), i.alias("total_in_sats"), o.alias("total_out_sats"), F.when(coinbase, 0).otherwise(F.greatest(F.lit(0), i - o)).cast("long").alias("fee_sats"),
        provenance(source).alias("provenance"),
    )


def address_records(tx: DataFrame) -> DataFrame:
    """(address, n_tx, total_received_sats, total_sent_sats, balance_sats) as far as the table's transactions tell."""
    side = lambda c, s: F.transform(F.coalesce(F.col(c), F.array()), lambda e: F.struct(e["address"].alias("a"), (F.coalesce(e["value_sats"], F.lit(0)) * int(s > 0)).alias("r"), (F.coalesce(e["value_sats"], F.lit(0)) * int(s < 0)).alias("s")))
    e = tx.select("txid", F.explode(F.concat(side("inputs", -1), side("outputs", 1))).alias("e")).where("e.a <> ''")
    t = e.groupBy(F.col("e.a").alias("address")).agg(F.count_distinct("txid").alias("n_tx"), F.sum("e.r").alias("total_received_sats"), F.sum("e.s").alias("total_sent_sats"))
    return t.withColumn("balance_sats", F.col("total_received_sats") - F.col("total_sent_sats")).withColumn("totals_derived_from_partial_history", F.lit(True))
