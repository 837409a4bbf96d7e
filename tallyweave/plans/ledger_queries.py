"""Queries of the ledger operators: behaviour, graph, cohorts, labels, metrics and tracing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import money
from tallyweave.operators import behavior, cohort, graph, labels, ledger, metrics, peel, serving, trace
from tallyweave.plans import analysis
from tallyweave.plans.ledger_sql import SQL
from tallyweave.session import Scratch
from tallyweave.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --------------------------------------------------------------------------- shared steps
def _ledger(spark: SparkSession, folder: str) -> ledger.Ledger:
    return ledger.from_orders(spark, folder)


def _base(spark: SparkSession, folder: str) -> DataFrame:
    """Features without the peel columns, for what does not read them."""
    return behavior.with_features(behavior.accumulators(_ledger(spark, folder)))


def _full(led: ledger.Ledger) -> DataFrame:
    """All 19 features of a ledger, which is flattened once."""
    led = led.stored()
    return behavior.with_features(behavior.accumulators(led), peel.peel_columns(led, peel.chain_members(led)))


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    with Scratch(spark) as scratch:
        scratch.hold(name)
        return scratch.keep(df, name)


def _kept_base(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, _base(spark, folder), "features")


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    led = _ledger(spark, folder)
    n = led.inp.select("address").unionByName(behavior.ext_out(led).select("address"))
    return behavior.edges(led, n.groupBy("address").count().where("count >= 2"))


# --------------------------------------------------------------------------- window documents
def _windows(spark: SparkSession, folder: str) -> DataFrame:
    """Features of all window documents: one row of each address and window, named by both; ``own`` is the address."""
    t = table(spark, folder, "address_features").where("address is not null")
    rest = [c for c in t.columns if c not in ("window_start", "address")]
    one = t.groupBy("window_start", "address").agg(F.min_by(F.struct(*rest), "row_id").alias("r"))
    key = F.concat(F.col("window_start").cast("string"), F.lit(":"), F.col("address")).alias("address")
    return _kept(spark, one.select(key, F.col("address").alias("own"), "r.first_seen", "r.last_seen", *[money.finite(F.col(f"r.{c}")).alias(c) for c in behavior.FEATURES]), "windows")


def _window_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The window documents' edges between the addresses named as in ``_windows``; redelivered ones once."""
    e = table(spark, folder, "edges").where("src is not null and dst is not null").dropDuplicates(["window_start", "src", "dst"])
    name = lambda c: F.concat(F.col("window_start").cast("string"), F.lit(":"), F.col(c)).alias(c)
    return e.select(name("src"), name("dst"), "value_sats", "n_txs", "first_time")


def _confirmed(spark: SparkSession, folder: str, f: DataFrame) -> DataFrame:
    lists = labels.confirmed(table(spark, folder, "label_ransomware"), table(spark, folder, "label_sanctions"))
    return f.select("address", "own").join(lists.withColumnRenamed("address", "own"), "own").select("address", "kind")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Weak labels of the window documents' addresses over cell cohorts, with a score to measure."""
    f = _windows(spark, folder)
    clusters = cohort.cell_cohorts(f)
    weak = cohort.weak_labels(f, clusters, cohort.cluster_risk(f, clusters), _confirmed(spark, folder, f))
    score = F.col("collector_score") * 0.5 + F.col("layering_score") * 0.5 + F.col("forward_ratio") * 0.3
    return _kept(spark, weak.join(f.select("address", score.alias("score")), "address").withColumn("pos", F.col("address")), "labelled")


def _risk(spark: SparkSession, folder: str) -> DataFrame:
    f = _windows(spark, folder)
    return cohort.cluster_risk(f, cohort.cell_cohorts(f))


# --------------------------------------------------------------------------- transactions
@_query
def tx_normalised(spark: SparkSession, folder: str) -> DataFrame:
    tx = table(spark, folder, "tx").where("txid is not null and provenance is not null")
    total = lambda c: F.aggregate(F.coalesce(c, F.array()), F.lit(0).cast("long"), lambda a, e: a + F.coalesce(e["value_sats"], F.lit(0)))
    none = F.size(F.filter(F.coalesce("inputs", F.array()), lambda e: e["address"].isNotNull())) == 0
    i, o = total("inputs"), total("outputs")
    return tx.select("delivery_id", "txid", i.alias("total_in"), o.alias("total_out"), none.alias("is_coinbase"), F.when(none, 0).otherwise(F.greatest(F.lit(0), i - o)).cast("long").alias("fee"))


@_query
def block_window(spark: SparkSession, folder: str) -> DataFrame:
    tx = table(spark, folder, "tx").withColumnRenamed("block_height", "height")
    return ledger.height_window(tx, days=2).agg(F.count("*").alias("n_rows"), F.min("height").alias("first_height"), F.max("height").alias("last_height"), F.count_distinct("height").alias("n_blocks"))


@_query
def address_history(spark: SparkSession, folder: str) -> DataFrame:
    tx = table(spark, folder, "tx").where("txid is not null")
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("inputs.address", none), F.coalesce("outputs.address", none)))
    return tx.select("txid", F.explode(both).alias("address")).where("address <> ''").groupBy("address").agg(F.count_distinct("txid").alias("n_tx"))


# --------------------------------------------------------------------------- behaviour
@_query
def address_flow(spark: SparkSession, folder: str) -> DataFrame:
    led = _ledger(spark, folder)
    f = behavior.receipts(behavior.ext_out(led)).join(behavior.spends(led), "address", "full").fillna(0, ["received_sats", "sent_sats"])
    r, s = F.col("received_sats"), F.col("sent_sats")
    return f.select("address", r.alias("received"), s.alias("sent"), (r - s).alias("balance"), F.when(r > 0, F.least(F.lit(1.0), s / r)).otherwise(F.lit(0.0)).alias("forward_ratio"))


@_query
def first_last_seen(spark: SparkSession, folder: str) -> DataFrame:
    led = _ledger(spark, folder)
    last = led.inp.select("address", "ts").unionByName(behavior.ext_out(led).select("address", "ts")).groupBy("address").agg(F.max("ts").alias("last_seen"))
    return last.join(behavior.first_seen(led), "address").select("address", "first_seen", "last_seen")


@_query
def change_outputs(spark: SparkSession, folder: str) -> DataFrame:
    led = _ledger(spark, folder)
    return led.out.join(led.inp.select("txid", "address").distinct(), ["txid", "address"], "left_semi").select("txid", "address", "value")


@_query
def degrees(spark: SparkSession, folder: str) -> DataFrame:
    led = _ledger(spark, folder)
    return behavior.degrees(behavior.counterparties(led, behavior.ext_out(led)))


def _paid(spark: SparkSession, folder: str) -> DataFrame:
    led = _ledger(spark, folder)
    return behavior.payments(led, behavior.ext_out(led), behavior.first_seen(led))


@_query
def split_width(spark: SparkSession, folder: str) -> DataFrame:
    return _paid(spark, folder).select("address", "max_split_width")


@_query
def paid_to_new(spark: SparkSession, folder: str) -> DataFrame:
    return _paid(spark, folder).select("address", "paid_to_total", "paid_to_new")


@_query
def turnaround(spark: SparkSession, folder: str) -> DataFrame:
    led = _ledger(spark, folder)
    return behavior.turnaround(led, behavior.ext_out(led))


@_query
def address_features_base(spark: SparkSession, folder: str) -> DataFrame:
    return _base(spark, folder)


@_query
def address_features(spark: SparkSession, folder: str) -> DataFrame:
    return _full(_ledger(spark, folder))


@_query
def ledger_features(spark: SparkSession, folder: str) -> DataFrame:
    """The same features of the addresses of ``tx``, one delivery of each transaction counting."""
    from tallyweave.operators.delivery import exactly_once

    blocks = ledger.blocks_of_tx(exactly_once(table(spark, folder, "tx")))
    return _full(ledger.from_blocks(_kept(spark, blocks, "blocks")))


@_query
def layering_hits(spark: SparkSession, folder: str) -> DataFrame:
    return _base(spark, folder).where("layering_score > 0").select("address", "layering_score")


@_query
def collector_hits(spark: SparkSession, folder: str) -> DataFrame:
    return _base(spark, folder).where("collector_score > 0").select("address", "collector_score")


@_query
def pattern_counts(spark: SparkSession, folder: str) -> DataFrame:
    return behavior.pattern_counts(_full(_ledger(spark, folder)))


@_query
def window_stats(spark: SparkSession, folder: str) -> DataFrame:
    return behavior.window_stats(_ledger(spark, folder), _base(spark, folder))


# --------------------------------------------------------------------------- graph
@_query
def edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


@_query
def adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return graph.adjacency(_edges(spark, folder))


@_query
def top_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.top_counterparties(graph.adjacency(_edges(spark, folder)))


@_query
def ego_2hop(spark: SparkSession, folder: str) -> DataFrame:
    adj = _kept(spark, graph.adjacency(_edges(spark, folder)), "adjacency")
    seed = adj.agg(F.min("address")).first()[0]
    return graph.ego_network(adj, seed, hops=2, max_nodes=500)


@_query
def induced_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.induced_edges(_edges(spark, folder), _base(spark, folder).where("n_tx_in >= 20"))


@_query
def components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all customer-supplier pairs."""
    lines, orders = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    pairs = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return graph.components(pairs.select(F.col("o_custkey").cast("long").alias("u"), (F.col("l_suppkey") + F.lit(1000000000)).cast("long").alias("v")))


@_query
def exit_points(spark: SparkSession, folder: str) -> DataFrame:
    return serving.exits(_base(spark, folder))


# --------------------------------------------------------------------------- peel chains
@_query
def peel_shaped_tx(spark: SparkSession, folder: str) -> DataFrame:
    return peel.peel_shaped(_ledger(spark, folder)).select("txid", "n_out", "total", "biggest", "carrier")


@_query
def spent_by(spark: SparkSession, folder: str) -> DataFrame:
    return peel.spent_by(_ledger(spark, folder))


@_query
def peel_successor(spark: SparkSession, folder: str) -> DataFrame:
    return peel.successors(_ledger(spark, folder)).select("txid", "carrier", "next")


@_query
def peel_walk_length(spark: SparkSession, folder: str) -> DataFrame:
    return peel.walk_lengths(_ledger(spark, folder))


@_query
def peel_members(spark: SparkSession, folder: str) -> DataFrame:
    return peel.chain_members(_ledger(spark, folder))


# --------------------------------------------------------------------------- cohorts, labels, scores
@_query
def scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    x = cohort.scaled(_base(spark, folder))
    return x.select("address", *[F.round(c, 6).alias(c) for c in behavior.CLUSTER_FEATURES])


@_query
def hdbscan_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.cohorts(_windows(spark, folder))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    e = table(spark, folder, "embeddings")
    n = e.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    dims = [f"c{i + 1}" for i in range(n)]
    return e.select(F.col("vec_id").alias("address"), "label", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(dims)]), dims


@_query
def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    e, dims = _vectors(spark, folder)
    return cohort.centroids(e, dims).select("label", *[F.round(f"{d}_c", 6).alias(d) for d in dims], F.round("radius", 6).alias("radius"))


@_query
def cluster_risk(spark: SparkSession, folder: str) -> DataFrame:
    return _risk(spark, folder)


@_query
def cluster_medians(spark: SparkSession, folder: str) -> DataFrame:
    f = _windows(spark, folder)
    return cohort.cluster_medians(f, cohort.cell_cohorts(f))


@_query
def cohort_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.cluster_counts(cohort.cell_cohorts(_windows(spark, folder)))


@_query
def clusters_list(spark: SparkSession, folder: str) -> DataFrame:
    return serving.clusters(_risk(spark, folder)).select("cluster", "size", "risk")


@_query
def weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).select("address", "y", "source")


@_query
def label_sources(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).groupBy("source").agg(F.count("*").alias("n"))


@_query
def fallback_score(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.fallback_score(_windows(spark, folder)).select("address", "score")


@_query
def top_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(_windows(spark, folder)).select("rank", "address", "score")


@_query
def tags(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder).select("address", F.array_join(serving.tags(), ",").alias("tags"))


def _analysis(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    f = _windows(spark, folder)
    return analysis.analyse(f, _window_edges(spark, folder), _confirmed(spark, folder, f))


@_query
def graph_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _analysis(spark, folder)["scores"]


@_query
def analysis_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The whole analysis: density cohorts, their risk, weak labels, graph scores and the ranking by them."""
    return _analysis(spark, folder)["ranking"]


@_query
def analysis_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _analysis(spark, folder)["clusters"]


@_query
def address_kind(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "address_features").where("address is not null").select("address").distinct().select("address", money.address_kind(F.col("address")).alias("kind"))


@_query
def human_amount(spark: SparkSession, folder: str) -> DataFrame:
    v = [0, 5, 999, 1000, 99999, 100000, 123456, 100000000, 123456789, 100000000000]
    return spark.createDataFrame([(x,) for x in v], "v long").select("v", money.human_coins(F.col("v")).alias("shown"))


@_query
def format_amount(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "edges").where("value_sats is not null").select(F.col("value_sats").alias("v")).distinct()
    return v.select("v", money.format_coins(F.col("v"), 4).alias("shown"))


@_query
def ransom_families(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "label_ransomware").withColumns({"family": F.coalesce(F.when(F.col("family") != "", F.col("family")), F.lit("Unlabeled")), "n_payments": F.coalesce("n_payments", F.lit(0))})
    return labels.ransom_families(r)


@_query
def confirmed_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels.confirmed(table(spark, folder, "label_ransomware"), table(spark, folder, "label_sanctions"))


@_query
def ransom_wallets(spark: SparkSession, folder: str) -> DataFrame:
    return labels.pick_wallets(table(spark, folder, "label_ransomware")).select("address", "n_payments")


# --------------------------------------------------------------------------- metrics
@_query
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(_labelled(spark, folder))


@_query
def prf(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.prf(metrics.confusion(_labelled(spark, folder)))


@_query
def youden_j(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.youden_j(metrics.confusion(_labelled(spark, folder)))


@_query
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.average_precision(_labelled(spark, folder))


@_query
def precision_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.precision_at(_labelled(spark, folder))


@_query
def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.best_threshold(_labelled(spark, folder))


@_query
def youden_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.best_threshold(_labelled(spark, folder), "youden")


@_query
def evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.evaluate(_labelled(spark, folder)).select("n", "n_positive", "base_rate", "tp", "f1", "youden_j", "average_precision", "precision_at_10", "precision_at_100", "labelled_accuracy")


# --------------------------------------------------------------------------- serving views
def _ranked(f: DataFrame) -> DataFrame:
    return cohort.top_ranked(cohort.fallback_score(f))


@_query
def api_overview(spark: SparkSession, folder: str) -> DataFrame:
    led = _ledger(spark, folder).stored()
    f = _kept(spark, behavior.with_features(behavior.accumulators(led), peel.peel_columns(led, peel.chain_members(led))), "features")
    blocks = led.txs.select((F.col("height") * 86400).alias("time"))  # a block of this ledger is a day
    return serving.overview(behavior.window_stats(led, f), behavior.pattern_counts(f), behavior.edges(led, f), blocks)


@_query
def api_ranking(spark: SparkSession, folder: str) -> DataFrame:
    view = serving.ranking(_ranked(_windows(spark, folder)), min_btc=0.05, limit=60, pattern="fanin")
    return view.select("rank", "address", "score", F.array_join("tags", ",").alias("tags"), "received_btc", "in_degree", "out_degree")


@_query
def api_address(spark: SparkSession, folder: str) -> DataFrame:
    f = _windows(spark, folder)
    c = cohort.cell_cohorts(f)
    return serving.address_view(f, _ranked(f), c, cohort.cluster_risk(f, c)).select("address", "exit_kind", "rank", "score", "cluster", "risk")


@_query
def address_counterparties(spark: SparkSession, folder: str) -> DataFrame:
    """The address view's lists: the 30 largest counterparties of every address and direction."""
    f = _kept_base(spark, folder)
    return serving.counterparties(f, behavior.edges(_ledger(spark, folder), f))


def _graph_view(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    f = _kept_base(spark, folder)
    e = _kept(spark, behavior.edges(_ledger(spark, folder), f), "edges")
    return serving.graph_view(f, e, _ranked(f), f.agg(F.min("address")).first()[0], hops=1, max_nodes=500)


@_query
def api_graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _graph_view(spark, folder)["nodes"]


@_query
def api_graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _graph_view(spark, folder)["edges"].select("src", "dst", "value_sats", "n_txs")


@_query
def high_risk_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    return serving.high_risk(_risk(spark, folder)).select("cluster", "size", "risk")


@_query
def report_tags(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder).select("address", F.array_join(serving.report_tags(), ",").alias("tags"))


@_query
def tx_parties(spark: SparkSession, folder: str) -> DataFrame:
    return serving.tx_parties(table(spark, folder, "tx"))


@_query
def nearest_assignment(spark: SparkSession, folder: str) -> DataFrame:
    e, dims = _vectors(spark, folder)
    rows = cohort.centroids(e, dims).select("label", *[f"{d}_c" for d in dims], "radius").orderBy("label").collect()  # one row a label
    found = cohort.assign_nearest(e.select("address", *dims), [(int(r[0]), list(r[1:-1]), r[-1]) for r in rows], tuple(dims))
    return found.groupBy("cluster").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- tracing
@_query
def classify_address(spark: SparkSession, folder: str) -> DataFrame:
    return trace.classify(trace.totals(_ledger(spark, folder)), opt=trace.TraceOptions(service_min_txs=60)).select("address", "kind", "confidence", "basis")


@_query
def value_floor(spark: SparkSession, folder: str) -> DataFrame:
    r = behavior.receipts(behavior.ext_out(_ledger(spark, folder))).where("received_sats > 0")
    return r.select("address", trace.value_floor(F.col("received_sats")).cast("long").alias("floor_sats"))


@_query
def haircut_step(spark: SparkSession, folder: str) -> DataFrame:
    led = _ledger(spark, folder)
    starts = behavior.ext_out(led).groupBy("address").agg(F.max("value").alias("value"))
    return trace.haircut_step(led, starts).select("txid", "src", "dst", "observed", "forwarded")


def _trace(spark: SparkSession, folder: str) -> trace.Trace:
    """From the address that received most of those that spend."""
    led = _ledger(spark, folder)
    source = trace.totals(led).where("sent > 0").orderBy(F.col("received").desc(), "address").first()[0]
    return trace.trace(led, source, trace.TraceOptions(budget=60))


@_query
def trace_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    return trace.endpoint_rows(spark, _trace(spark, folder))


@_query
def value_by_hop(spark: SparkSession, folder: str) -> DataFrame:
    return trace.hop_rows(spark, _trace(spark, folder))


__all__ = ["QUERIES", "SQL"]
