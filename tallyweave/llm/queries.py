"""Queries of the operators of this package, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, components, distinct_runs, grid_clusters, heavy_hitters, langid, packing
from tallyweave.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
SUPPORT = 0.005
ALL_GROUPINGS = [(), ("day_no",), ("source",), ("side",), ("day_no", "source"), ("day_no", "side"), ("source", "side"), ("day_no", "source", "side")]


def _address_values(spark: SparkSession, folder: str) -> DataFrame:
    edges, tx = table(spark, folder, "edges"), table(spark, folder, "tx")
    a = edges.select(F.lit("edges").alias("field"), F.explode(F.array("src", "dst")).alias("value"))
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(F.col("inputs.address"), none), F.coalesce(F.col("outputs.address"), none))
    b = tx.select(F.lit("tx").alias("field"), F.explode(both).alias("value")).where("value <> ''")
    return a.unionByName(b)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_hitters.frequent_exact(_address_values(spark, folder), SUPPORT).select("field", F.col("value").alias("address"))


def p1_frequent(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_hitters.frequent(_address_values(spark, folder), SUPPORT)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    counts = distinct_runs.distinct_addresses(table(spark, folder, "tx"), [("day_no", "source", "side")])
    n = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("n_distinct"))), F.lit(0)).alias(side)
    both = counts.where("day_no is not null and source is not null").groupBy("day_no", "source").agg(n("in"), n("out"))
    return both.where("`in` >= 1 and out >= 5 * `in`").select("day_no", "source")


def p2_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_runs.distinct_addresses(table(spark, folder, "tx"), ALL_GROUPINGS)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.co_spent(table(spark, folder, "tx"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return grid_clusters.mutual_clusters(table(spark, folder, "address_features"))


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return grid_clusters.described_clusters(table(spark, folder, "address_features"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"))


def p9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(table(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.label_faults(langid.identify(table(spark, folder, "documents"))).select("doc_id", "seg_no", "lang")


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents")).drop("named")


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_frequent, p2_found, p2_distinct, p5_found, p6_found, p6_clusters, p8_ids, p9_packing, p9_report, p10_found, p10_languages)
}

_ADDRESSES = """
a as (select 'in' side, block_height // 144 day_no, provenance.source source, unnest(inputs).address address from tx
  union all select 'out', block_height // 144, provenance.source, unnest(outputs).address from tx)"""
SQL: dict[str, str] = {
    "p1_found": f"""with v as (
  select 'edges' field, unnest([src, dst]) address from edges
  union all select 'tx', unnest(list_concat(list_transform(coalesce(inputs, []), lambda e: e.address), list_transform(coalesce(outputs, []), lambda e: e.address))) from tx),
n as (select field, address, count(*) n from v where address is not null and (field = 'edges' or address <> '') group by 1, 2),
t as (select field, sum(n) total from n group by 1)
select field, address from n join t using (field) where n >= {SUPPORT} * total""",
    "p2_found": f"""with {_ADDRESSES},
c as (select day_no, source, count(distinct address) filter (side = 'in') i, count(distinct address) filter (side = 'out') o
  from a where address <> '' and day_no is not null and source is not null group by 1, 2)
select day_no, source from c where i >= 1 and o >= 5 * i""",
    "p2_distinct": "with " + _ADDRESSES + ", f as (select * from a where address <> ''), c as (" + " union all ".join(
        f"select '{','.join(g)}' grouping, " + ", ".join(k if k in g else f"null::{'bigint' if k == 'day_no' else 'varchar'} {k}" for k in ("day_no", "source", "side"))
        + " , count(distinct address) n_distinct from f" + (f" group by {', '.join(g)}" if g else "")
        for g in ALL_GROUPINGS
    ) + ") select *, least(n_distinct::double * (n_distinct::double - 1) / 2 / pow(2::double, 64), 1) error_bound from c",
    "p5_found": """with recursive m as (select distinct delivery_id d, address a from (select delivery_id, unnest(inputs).address address from tx) where address <> ''),
e as (select distinct x.a a, y.a b from m x join m y using (d) where x.a <> y.a),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select min(b) group_address, a address from r group by a""",
    "p6_found": """with r as (
  select row_id, list_transform(x, lambda v: case when v is null or isnan(v) or isinf(v) then 0 else sign(v) * ln(1 + abs(v)) end) y
  from address_features where len(x) = 19),
near as (select a.row_id a, b.row_id b from r a join r b on abs(a.y[1] - b.y[1]) <= 0.05
  and list_max(list_transform(list_zip(a.y, b.y), lambda p: abs(p[1] - p[2]))) <= 0.05),
hood as (select a, list(b order by b) h from near group by a),
sets as (select h from hood where len(h) >= 5 group by h having count(*) = len(h))
select h[1] cluster_row_id, unnest(h) row_id from sets""",
}
