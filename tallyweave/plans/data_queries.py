"""Queries of the data-preparation operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import delivery, event_features, nested
from tallyweave.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.child_rows(table(spark, folder, "tx"), table(spark, folder, "raw_tx"))


def p3_transfers(spark: SparkSession, folder: str) -> DataFrame:
    return nested.transfers(table(spark, folder, "tx"), table(spark, folder, "raw_tx"))


def p3_raw_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every flat table that the merged schema of raw_tx gives."""
    parts = [t.select(F.lit(name).alias("table_name"), "_key") for name, t in nested.raw_tables(table(spark, folder, "raw_tx")).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table_name").agg(F.count("*").alias("n_rows"), F.count_distinct("_key").alias("n_keys"))


def p3_flat_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The contents of those tables: key, parent, place and the columns as JSON (null ones left out)."""
    parts = []
    for name, t in nested.raw_tables(table(spark, folder, "raw_tx"), nested.SIDES).items():
        own = [F.col(f"`{c}`") for c in t.columns if c not in ("_key", "_parent", "_ord")]
        parent, place = (F.col(c) if c in t.columns else F.lit(None).cast(kind) for c, kind in (("_parent", "string"), ("_ord", "int")))
        parts.append(t.select(F.lit(name).alias("table_name"), "_key", parent.alias("parent_key"), place.alias("place"), (F.to_json(F.struct(*own)) if own else F.lit("{}")).alias("fields")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("_key", "row_key")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.surplus_pairs(table(spark, folder, "tx"))


def p4_exactly_once(spark: SparkSession, folder: str) -> DataFrame:
    kept = delivery.exactly_once(table(spark, folder, "tx"))
    return kept.select("delivery_id", "txid", "block_height", "time", F.size("inputs").alias("n_inputs"), F.size("outputs").alias("n_outputs"))


def p7_features(spark: SparkSession, folder: str) -> DataFrame:
    return event_features.event_features(table(spark, folder, "tx"))


def p7_feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    return event_features.feature_rows(event_features.event_features(table(spark, folder, "tx")))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p3_found, p3_transfers, p3_raw_tables, p3_flat_rows, p4_found, p4_exactly_once, p7_features, p7_feature_rows)
}

_ID = "nullif(lower(trim(txid)), '')"
_RAW = """
valid as (select record_id, body::json b from raw_tx where body is not null and json_valid(body)),
listed as (
  select record_id, case
    when json_type(b) = 'ARRAY' then from_json(b, '["JSON"]')
    when json_type(b, '$.txs') = 'ARRAY' then from_json(json_extract(b, '$.txs'), '["JSON"]')
    when json_type(b, '$.txs') = 'OBJECT' then [json_extract(b, '$.txs')]
    when json_type(b, '$.tx') = 'ARRAY' then from_json(json_extract(b, '$.tx'), '["JSON"]')
    when json_type(b, '$.tx') = 'OBJECT' then [json_extract(b, '$.tx')]
    when json_type(b, '$.data.items') = 'ARRAY' then list_transform(from_json(json_extract(b, '$.data.items'), '["JSON"]'), lambda i: json_extract(i, '$.tx'))
    when json_type(b, '$.data.items') = 'OBJECT' then [json_extract(b, '$.data.items.tx')]
    when json_type(b) = 'OBJECT' and json_type(b, '$.txs') is null and json_type(b, '$.tx') is null and json_type(b, '$.data') is null then [b]
    end l from valid),
txs as (select record_id, unnest(range(len(l))) tx_pos, unnest(l) t from listed),
members as (
  select record_id, tx_pos, 'in' side, unnest(['vin', 'inputs']) m, t from txs
  union all select record_id, tx_pos, 'out', unnest(['vout', 'outputs', 'out']), t from txs),
lists as (
  select record_id, tx_pos, side, case json_type(t, '$.' || m)
    when 'ARRAY' then from_json(json_extract(t, '$.' || m), '["JSON"]')
    when 'OBJECT' then [json_extract(t, '$.' || m)] end l from members),
raw_items as (select record_id, tx_pos, side, unnest(range(len(l))) item_pos, unnest(l) e from lists)
"""
_CHILDREN = """
tx_items as (
  select delivery_id, 'in' side, unnest(range(len(inputs))) item_pos, unnest(inputs) e from tx),
tx_outs as (
  select delivery_id, 'out' side, unnest(range(len(outputs))) item_pos, unnest(outputs) e from tx)
"""
_KEPT = f"""
numbered as (select *, {_ID} k, row_number() over (partition by {_ID} order by delivery_id) r from tx),
kept as (select * from numbered where k is null or r = 1)
"""

SQL: dict[str, str] = {
    "p3_found": f"""with {_RAW}, {_CHILDREN}
select 'tx' origin, delivery_id row_id, 0::int tx_pos, side, item_pos::int item_pos from tx_items where e is not null
union all select 'tx', delivery_id, 0, side, item_pos::int from tx_outs where e is not null
union all select 'raw_tx', record_id, tx_pos::int, side, item_pos::int from raw_items where e is not null and json_type(e) <> 'NULL'""",
    "p3_transfers": f"""with {_RAW}, {_CHILDREN}
select 'tx' origin, delivery_id row_id, 0::int tx_pos, side, item_pos::int item_pos, e.address address, e.value_sats value_sats from tx_items where e is not null
union all select 'tx', delivery_id, 0, side, item_pos::int, e.address, e.value_sats from tx_outs where e is not null
union all select 'raw_tx', record_id, tx_pos::int, side, item_pos::int,
  coalesce(e->>'$.address', e->>'$.addr', e->>'$.scriptpubkey_address', e->>'$.prevout.scriptpubkey_address', e->>'$.prev_out.addr'),
  coalesce(try_cast(e->>'$.value_sats' as bigint), try_cast(e->>'$.value' as bigint), try_cast(e->>'$.prevout.value' as bigint), try_cast(e->>'$.prev_out.value' as bigint))
from raw_items where e is not null and json_type(e) <> 'NULL'""",
    # a path without its list places; lists don't hold lists in these bodies
    "p3_raw_tables": f"""with {_RAW},
good as (select t from txs where t is not null and json_type(t) <> 'NULL'),
tree as (select regexp_replace(substr(j.fullkey, 2), '\\[[0-9]+\\]', '', 'g') p, j.type k from good, json_tree(good.t) j),
paths as (select distinct p from tree where k = 'ARRAY'),
counted as (select p, count(*) n from tree where p in (select p from paths) and k not in ('ARRAY', 'NULL') group by 1),
steps as (select p, n, unnest(range(2, len(string_split(p, '.')) + 1)) i, string_split(p, '.') s from counted),
parted as (select t.p, n, i, s[i] own, x.p is not null under from (select *, array_to_string(s[1:i - 1], '.') before from steps) t left join paths x on x.p = t.before),
named as (select p, n, string_agg(case when i = 2 or under then '.' else '__' end || own, '' order by i) suffix from parted group by 1, 2)
select 'tx' table_name, count(*) n_rows, count(*) n_keys from good
union all select 'tx' || suffix, n, n from named""",
    "p4_found": f"""with k as (select {_ID} k, delivery_id d from tx),
f as (select k, min(d) f from k where k is not null group by k)
select f first_delivery_id, d delivery_id from k join f using (k) where d <> f""",
    "p4_exactly_once": f"""with {_KEPT}
select delivery_id, txid, block_height, time, len(inputs)::int n_inputs, len(outputs)::int n_outputs from kept""",
    "p7_feature_rows": f"""with {_KEPT},
items as (
  select 'in' side, provenance.source s, time, unnest(inputs).address a, unnest(inputs).value_sats v from kept
  union all select 'out', provenance.source, time, unnest(outputs).address, unnest(outputs).value_sats from kept)
select a address, side || '|' || coalesce(s, '-') || '|' || coalesce(length(abs(v)::varchar)::varchar, '-') event_type,
  count(*) n, max(nullif(time, 0)) latest, sum(coalesce(v, 0))::bigint total_sats
from items where a <> '' group by 1, 2""",
}
