"""Cohorts of addresses with like behaviour: scaling, density clustering, assignment, risk, weak labels, scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.money import finite
from tallyweave.operators.behavior import CLUSTER_FEATURES, FEATURES
from tallyweave.operators.ranks import percentiles
from tallyweave.session import Scratch

_BLOCK_CELLS = 2_000_000  # distances held at once


def scaled(features: DataFrame, columns: tuple[str, ...] = CLUSTER_FEATURES) -> DataFrame:
    """address and standardised ln(1+x) of columns (negative values as 0, population deviation, constant columns keep scale 1)."""
    logs = features.select("address", *[F.log1p(F.greatest(finite(F.col(c)), F.lit(0.0))).alias(c) for c in columns])
    stats = logs.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    one = logs.crossJoin(F.broadcast(stats))  # one row
    scale = lambda c: F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(F.lit(1.0))
    return one.select("address", *[((F.col(c) - F.col(f"{c}_m")) / scale(c)).alias(c) for c in columns])


# --------------------------------------------------------------------------- density clustering
def _spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (a, b, distance) of a minimum spanning tree under mutual reachability, by Prim with one row at a time."""
    n = len(x)
    best, source = np.full(n, np.inf), np.zeros(n, np.int64)
    todo = np.ones(n, bool)
    columns = [np.ascontiguousarray(c) for c in x.T]
    edges = np.empty((max(n - 1, 0), 3))
    at = 0
    for k in range(n - 1):
        todo[at] = False
        d = np.maximum(np.maximum(np.sqrt(sum((c - c[at]) ** 2 for c in columns)), core), core[at])
        nearer = todo & (d < best)
        best[nearer], source[nearer] = d[nearer], at
        nxt = int(np.where(todo, best, np.inf).argmin())
        edges[k] = source[nxt], nxt, best[nxt]
        at = nxt
    return edges[np.argsort(edges[:, 2], kind="stable")]


def density_labels(x: np.ndarray, min_size: int, min_samples: int = 5) -> np.ndarray:
    """Hierarchical density clustering with excess-of-mass selection; -1 is noise.

    Core distance is that to the ``min_samples``-th nearest point, the point
    itself included. The root is never selected.
    """
    n = len(x)
    if n < max(2, min_size):
        return np.full(n, -1)
    k = min(min_samples, n) - 1
    core = np.empty(n)
    block = max(1, _BLOCK_CELLS // n)
    for a in range(0, n, block):
        # column by column: the differences of all dimensions at once would not fit for many points
        d = np.zeros((min(block, n - a), n))
        for c in x.T:
            d += (c[a : a + block, None] - c[None]) ** 2
        core[a : a + block] = np.sqrt(np.partition(d, k, axis=1)[:, k])
    # single-linkage tree: node n+i joins two nodes at a distance
    edges = _spanning_tree(x, core)
    parent = np.arange(2 * n - 1)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kids, size, height = np.zeros((n - 1, 2), np.int64), np.ones(2 * n - 1, np.int64), np.zeros(2 * n - 1)
    for i, (a, b, d) in enumerate(edges):
        l, r = top(int(a)), top(int(b))
        parent[l] = parent[r] = n + i
        kids[i], size[n + i], height[n + i] = (l, r), size[l] + size[r], d

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += kids[v - n].tolist()
        return out

    # condensed tree: a cluster lives from its birth until it splits into two large enough parts
    birth, stability, members, children = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    todo, fresh = [(2 * n - 2, 0)], 1
    while todo:
        node, c = todo.pop()
        while True:
            if node < n:
                members[c].append(node)
                break
            lam = 1 / height[node] if height[node] > 0 else 1e12
            l, r = kids[node - n]
            if size[l] >= min_size and size[r] >= min_size:
                for child in (int(l), int(r)):
                    birth[fresh], stability[fresh], members[fresh], children[fresh] = lam, 0.0, [], []
                    children[c].append(fresh)
                    stability[c] += (lam - birth[c]) * size[child]
                    todo.append((child, fresh))
                    fresh += 1
                break
            for child in (int(l), int(r)):
                if size[child] < min_size:
                    fallen = leaves(child)
                    members[c] += fallen
                    stability[c] += (lam - birth[c]) * len(fallen)
            keep = [int(v) for v in (l, r) if size[v] >= min_size]
            if not keep:
                break
            node = keep[0]
    chosen: set[int] = set()
    total = dict(stability)
    for c in sorted(children, reverse=True):
        if c == 0:
            continue
        below = sum(total[k] for k in children[c])
        if children[c] and below > stability[c]:
            total[c] = below
        else:
            stack = list(children[c])
            while stack:
                v = stack.pop()
                chosen.discard(v)
                stack += children[v]
            chosen.add(c)
    labels = np.full(n, -1)
    for name, c in enumerate(sorted(chosen)):
        stack = [c]
        while stack:
            v = stack.pop()
            labels[members[v]] = name
            stack += children[v]
    return labels


def cohorts(features: DataFrame, columns: tuple[str, ...] = CLUSTER_FEATURES, min_size: int = 15, max_points: int = 60_000, seed: int = 42) -> DataFrame:
    """(address, cluster): density clusters fitted on at most ``max_points`` addresses, all others assigned.

    Half of the fitted points are the most active, half a seeded sample of the
    rest; they alone travel to the driver. Every other address goes to the
    nearest centroid, or to -1 where that is further than the cluster's 90th
    percentile of distances. Centroids are few and travel as literals.
    """
    spark = features.sparkSession
    x = scaled(features, columns)
    active = x.withColumn("activity", sum(F.col(c) for c in columns))
    total = active.count()
    if total > max_points:
        head = active.orderBy(F.col("activity").desc(), "address").limit(max_points // 2)
        rest = active.join(head.select("address"), "address", "left_anti").orderBy(F.xxhash64(F.lit(seed), "address")).limit(max_points - max_points // 2)
        fit = head.unionByName(rest)
    else:
        fit = active
    points = fit.select("address", *columns).toPandas().sort_values("address").reset_index(drop=True)
    m = points[list(columns)].to_numpy(float)
    labels = density_labels(m, max(min_size, len(m) // 200))
    fitted = spark.createDataFrame(pd.DataFrame({"address": points.address.astype(str), "cluster": labels.astype("int32")}), "address string, cluster int")
    if total <= max_points:
        return fitted
    cents = []
    for c in sorted(set(labels.tolist()) - {-1}):
        own = m[labels == c]
        centre = own.mean(0)
        cents.append((c, centre, max(float(np.percentile(np.sqrt(((own - centre) ** 2).sum(1)), 90)), 1e-6)))
    others = x.join(fitted, "address", "left_anti")
    return fitted.unionByName(assign_nearest(others, cents, columns))


def cell_cohorts(features: DataFrame, columns: tuple[str, ...] = CLUSTER_FEATURES, min_size: int = 5) -> DataFrame:
    """(address, cluster): cohorts by the cell of whole logarithms ln(1+x) in each column; cells of fewer rows are noise (-1).

    A cohort without fitting: every address takes part, and a new one falls into
    its cell without another look at the others. The number of a cell holds two
    decimal digits a column.
    """
    cell = F.lit(0)
    for c in columns:
        cell = cell * 100 + F.floor(F.log1p(F.greatest(finite(F.col(c)), F.lit(0.0)))).cast("int")
    cells = features.select("address", cell.cast("int").alias("cluster"))
    large = cells.groupBy("cluster").count().where(F.col("count") >= min_size).select("cluster", F.lit(True).alias("large"))
    return cells.join(large, "cluster", "left").select("address", F.when(F.col("large"), F.col("cluster")).otherwise(-1).alias("cluster"))


def assign_nearest(x: DataFrame, centroids: list[tuple[int, np.ndarray, float]], columns: tuple[str, ...]) -> DataFrame:
    """(address, cluster): the nearest of a few centroids (ties: the lowest label), -1 beyond its radius."""
    if not centroids:
        return x.select("address", F.lit(-1).alias("cluster"))
    ds = [
        F.struct(F.sqrt(sum((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(columns, centre))).alias("d"), F.lit(int(k)).alias("k"), F.lit(float(r)).alias("r"))
        for k, centre, r in centroids
    ]
    return x.select("address", F.array_min(F.array(*ds)).alias("b")).select("address", F.when(F.col("b.d") <= F.col("b.r"), F.col("b.k")).otherwise(-1).alias("cluster"))


def centroids(points: DataFrame, dims: list[str], label: str = "label") -> DataFrame:
    """(label, mean of each dimension, radius): radius is the 90th percentile of member distances, 1e-6 at least."""
    means = points.groupBy(label).agg(*[F.avg(d).alias(f"{d}_c") for d in dims])
    dist = points.join(means, label).select(label, F.sqrt(sum((F.col(d) - F.col(f"{d}_c")) ** 2 for d in dims)).alias("dist"))
    with Scratch(points.sparkSession) as scratch:
        radius = percentiles(dist, [label], ["dist"], 0.9, scratch)
    return means.join(radius.select(label, F.greatest("dist", F.lit(1e-6)).alias("radius")), label)


# --------------------------------------------------------------------------- risk, labels, scores
# Weights of the medians in a cluster's risk, and what a short holding time adds. Fixed values.
RISK_WEIGHTS = {"layering_score": 0.30, "collector_score": 0.30, "peel_score": 0.20, "forward_ratio": 0.15}
SHORT_HOLDING_SECONDS, SHORT_HOLDING_RISK = 600, 0.05


def cluster_medians(features: DataFrame, clusters: DataFrame, columns: tuple[str, ...] = CLUSTER_FEATURES) -> DataFrame:
    """(cluster, size, is_noise, exact median of each column); a cluster with most rows is ordered in ranges, not in one task."""
    with Scratch(features.sparkSession) as scratch:
        scratch.hold("joined")
        joined = scratch.keep(features.select("address", *columns).join(clusters.select("address", "cluster"), "address"), "joined")
        m = percentiles(joined, ["cluster"], list(columns), 0.5, scratch)
    return m.select("cluster", "size", (F.col("cluster") == -1).alias("is_noise"), *columns)


def cluster_counts(clusters: DataFrame) -> DataFrame:
    """One row: the number of clusters without noise, and of addresses in noise."""
    return clusters.agg(F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"), F.count_if(F.col("cluster") == -1).alias("n_noise"))


def cluster_risk(features: DataFrame, clusters: DataFrame) -> DataFrame:
    """Size, medians and risk of each cluster; noise (-1) is scored too."""
    names = {"layering_score": "median_layering", "collector_score": "median_collector", "peel_score": "median_peel", "forward_ratio": "median_forward_ratio", "avg_holding_time": "median_holding_seconds"}
    m = cluster_medians(features, clusters, tuple(names))
    risk = sum((F.lit(w) * F.col(c) for c, w in RISK_WEIGHTS.items()), start=F.lit(0.0)) + F.when(F.col("avg_holding_time") < SHORT_HOLDING_SECONDS, SHORT_HOLDING_RISK).otherwise(0.0)
    return m.select(
        "cluster", "size", "is_noise", F.round(F.least(F.lit(1.0), risk), 4).alias("risk"),
        *[F.round(c, 1 if c == "avg_holding_time" else 4).alias(n) for c, n in names.items()],
    )


def weak_labels(features: DataFrame, clusters: DataFrame, risk: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(address, y, source); confirmed lists win over everything inferred.

    ``confirmed`` has (address, kind). High-risk clusters are at most as many as
    clusters; the join sides are picked by size at run time.
    """
    bad = risk.where("risk >= 0.35 and not is_noise and size >= 5").select("cluster", F.lit(True).alias("bad"))
    f = features.join(clusters, "address", "left").join(bad, "cluster", "left").join(confirmed.select("address", "kind"), "address", "left")
    c = F.col
    pattern = ((c("layering_score") > 0.25) | (c("collector_score") > 0.25) | ((c("peel_score") > 0.6) & (c("forward_ratio") > 0.9))) & (c("received_btc") > 0.001)
    quiet = (c("layering_score") == 0) & (c("collector_score") == 0) & (c("peel_score") < 0.2) & (c("forward_ratio") < 0.8) & (c("avg_holding_time") > 3600)
    source = (
        F.when(c("kind").isNotNull(), F.concat(F.lit("confirmed_"), "kind")).when(pattern, "behavioural_pattern").when(c("bad"), "hdbscan_cluster").when(quiet, "quiet_behaviour").otherwise("unlabelled")
    )
    y = F.when(c("kind").isNotNull() | pattern | F.coalesce("bad", F.lit(False)), 1).otherwise(0)
    return f.select("address", y.alias("y"), source.alias("source"))


def fallback_score(features: DataFrame) -> DataFrame:
    return features.select("*", (F.col("layering_score") * 0.5 + F.col("collector_score") * 0.5).alias("score"))


def top_ranked(scored: DataFrame, k: int = 25) -> DataFrame:
    """The k highest scores, ties by address, with their rank."""
    top = scored.orderBy(F.col("score").desc(), "address").limit(k)
    from pyspark.sql import Window as W

    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "address")))  # k rows


def graph_scores(features: DataFrame, edges: DataFrame, labels: DataFrame, hops: int = 4, seed: int = 42) -> DataFrame:
    """(address, y, score, split): a logistic model over own features and ``hops`` rounds of neighbour means.

    Both directions of every edge count. Six of ten addresses train, two
    validate, two test, by hash of the address; scaling is that of the training
    part and positives are weighted by negatives over positives. Fewer than 50
    rows or 10 positives raise an error. The score agrees with *weak labels*; it
    ranks and is no probability.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scratch = Scratch(features.sparkSession)
    scratch.hold("wide")
    bucket = F.pmod(F.xxhash64(F.lit(seed), "address"), F.lit(10))
    split = F.when(bucket < 6, "train").when(bucket < 8, "validation").otherwise("test")
    logs = features.join(labels.select("address", "y"), "address").select(
        "address", "y", split.alias("split"), *[(F.signum(c) * F.log1p(F.abs(finite(F.col(c))))).alias(c) for c in FEATURES]
    )
    logs = scratch.keep(logs, "logs")
    n, positives = logs.agg(F.count("*"), F.sum("y")).first()
    if n < 50 or (positives or 0) < 10:
        raise ValueError("fewer than 50 rows or 10 positives")
    s = logs.where("split = 'train'").agg(*[f(c) for c in FEATURES for f in (F.avg, F.stddev_pop)]).first()
    own = [((F.col(c) - float(s[2 * i] or 0)) / F.lit(float(s[2 * i + 1] or 1) or 1.0)).alias(c) for i, c in enumerate(FEATURES)]
    state = scratch.keep(logs.select("address", "y", "split", *own), "state")
    both = scratch.keep(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "both")
    names, current = list(FEATURES), state.select("address", *FEATURES)
    wide = state
    for h in range(1, hops + 1):
        mean = both.join(current.withColumnRenamed("address", "src"), "src").groupBy(F.col("dst").alias("address")).agg(*[F.avg(c).alias(c) for c in FEATURES])
        current = scratch.keep(state.select("address").join(mean, "address", "left").fillna(0.0), f"hop{h}")
        wide = wide.join(current.toDF("address", *[f"{c}_{h}" for c in FEATURES]), "address")
        names += [f"{c}_{h}" for c in FEATURES]
    p = logs.where("split = 'train'").agg(F.sum("y")).first()[0] or 0
    t = logs.where("split = 'train'").count()
    weight = F.when(F.col("y") == 1, float((t - p) / max(p, 1))).otherwise(1.0)
    rows = scratch.keep(wide, "wide")
    vec = VectorAssembler(inputCols=names, outputCol="v").transform(rows).withColumn("w", weight)
    model = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=5e-4, maxIter=50).fit(vec.where("split = 'train'"))
    out = model.transform(vec)
    scratch.close()
    return out.select("address", "y", vector_to_array("probability")[1].alias("score"), "split")
