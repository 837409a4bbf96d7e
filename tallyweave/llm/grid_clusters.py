"""Clusters of mutually similar records, by a grid over log-scaled features.

Two records are similar if all their scaled features differ by at most ``eps``.
Features are quantised to cells. A record lies in every cell that its interval
of width ``eps`` around each value touches, so two similar records always share
a cell. Cells are counted. The first grid takes the few features that spread
most, so a record is in 2 ** _GRID_FEATURES cells at worst. A crowded cell is cut
into slabs along the feature that spreads most within it, at its own quantiles,
and again as long as it is crowded and some feature spreads over several ``eps``;
a slab is at least four ``eps`` wide, so a cut puts a record into two slabs at
most. In a cell, records are split at gaps of more than ``eps`` in any feature,
and what remains is searched breadth first, every record found leaving the search:
the denser a cell, the fewer comparisons each record takes. A cell gives links
of a spanning star per local component, never all pairs. Minimum labels are
propagated over the links to convergence. Exact copies are one point with a weight.

Mutual similarity of a whole component needs no pairs either: it holds just if
no feature's range in the component exceeds ``eps``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.session import Scratch

N_FEATURES = 19
EPS = 0.05
_CELL_ROWS = 20_000
_WIDTH = 1.0
_GRID_FEATURES = 8
_SLAB = 4  # least width of a slab, in eps
_MAX_CUTS = 40  # of one cell, one after the other
_BUCKET_ROWS = 50_000


def scaled(x: Column) -> Column:
    """sign(v) ln(1+|v|) of each element; null and non-finite ones count as 0."""

    def one(v: Column) -> Column:
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
        return F.when(ok, F.signum(v) * F.log1p(F.abs(v))).otherwise(F.lit(0.0)) + F.lit(0.0)

    return F.transform(x, one)


def _cells(y: Column, features: list[int], width: float, eps: float) -> Column:
    """Hashes of all cells of a row: in each of some features the one or two that the interval touches."""
    keys = F.array(F.lit(0).cast("long"))
    for d in features:
        v = y[d]
        # zero lies in the middle of a cell, since it is the most frequent value
        low, high = (F.floor((v + s * eps / 2 * (1 + 1e-9)) / width + 0.5).cast("long") for s in (-1, 1))
        keys = F.flatten(F.transform(keys, _extend(F.array_distinct(F.array(low, high)))))
    return keys


def _extend(choices: Column) -> Callable[[Column], Column]:
    return lambda h: F.transform(choices, lambda c: F.xxhash64(h, c))


# --------------------------------------------------------------------------- inside a cell
def _reached(y: np.ndarray, eps: float) -> list[np.ndarray]:
    """Connected components of rows, by breadth-first search in the order of the first column.

    Each row looks through the unreached rows within ``eps`` in the first column
    only, and what it finds is looked through no more. Unreached rows are held
    column by column and closed up when a tenth of them is gone.
    """
    order = np.argsort(y[:, 0], kind="stable")
    z = y[order]
    n, head = len(z), min(4, z.shape[1])
    reach = eps * (1 + 1e-12)
    free = np.ones(n, bool)
    alive, columns, open_, gone = np.arange(n), [np.ascontiguousarray(z[:, d]) for d in range(head)], np.ones(n, bool), 0
    out = []
    for start in range(n):
        if not free[start]:
            continue
        free[start] = False
        found, todo = [start], [start]
        while todo:
            p = todo.pop()
            a, b = np.searchsorted(columns[0], (z[p, 0] - reach, z[p, 0] + reach))
            near = open_[a:b].copy()
            for d in range(head):
                near &= np.abs(columns[d][a:b] - z[p, d]) <= eps
            at = a + np.flatnonzero(near)
            rows = alive[at]
            fresh = free[rows]
            at, rows = at[fresh], rows[fresh]
            for d in range(head, z.shape[1]):
                if not rows.size:
                    break
                ok = np.abs(z[rows, d] - z[p, d]) <= eps
                at, rows = at[ok], rows[ok]
            if rows.size:
                free[rows] = open_[at] = False
                found += rows.tolist()
                todo += rows.tolist()
                gone += rows.size
                if 10 * gone > alive.size:
                    keep = free[alive]
                    alive, columns, gone = alive[keep], [c[keep] for c in columns], 0
                    open_ = np.ones(alive.size, bool)
        if len(found) > 1:
            out.append(order[found])
    return out


def local_components(y: np.ndarray, eps: float) -> list[np.ndarray]:
    """Row numbers of the connected components with at least two rows."""
    out: list[np.ndarray] = []
    todo = [np.arange(len(y))]
    while todo:
        rows = todo.pop()
        if len(rows) < 2:
            continue
        part = y[rows]
        span = part.max(0) - part.min(0)
        if (span <= eps).all():
            out.append(rows)
            continue
        wide = np.argsort(-span)
        for d in wide[span[wide] > eps]:
            order = np.argsort(part[:, d], kind="stable")
            gaps = np.flatnonzero(np.diff(part[order, d]) > eps) + 1
            if gaps.size:
                todo += [rows[s] for s in np.split(order, gaps)]
                break
        else:
            out += [rows[c] for c in _reached(part[:, wide], eps)]
    return out


# --------------------------------------------------------------------------- cells of a bounded size
def _slabs(placed: DataFrame, crowded: DataFrame, eps: float, n: int) -> DataFrame:
    """(cell, d, cuts): where each crowded cell is cut along the feature that spreads most in it; cells without such a feature are left out.

    Quantiles come from mergeable sketches, so no cell is gathered. Cuts are
    ``_SLAB`` eps apart and from the ends of the feature's range.
    """
    steps = [k / 16 for k in range(1, 16)]
    own = placed.join(crowded.select("cell"), "cell", "left_semi")
    stats = own.groupBy("cell").agg(*[F.struct(F.min(F.col("y")[d]).alias("a"), F.max(F.col("y")[d]).alias("z"), F.percentile_approx(F.col("y")[d], steps, 500).alias("q")).alias(f"f{d}") for d in range(n)])

    def choice(d: int) -> Column:
        f = F.col(f"f{d}")
        far = F.lit(_SLAB * eps)
        kept = F.aggregate(
            f["q"], F.array().cast("array<double>"),
            lambda acc, v: F.when((v - F.coalesce(F.try_element_at(acc, F.lit(-1)), f["a"]) >= far) & (f["z"] - v >= far), F.array_append(acc, v)).otherwise(acc),
        )
        return F.struct(F.size(kept).alias("n_cuts"), (f["z"] - f["a"]).alias("span"), F.lit(d).alias("d"), kept.alias("cuts"))

    best = F.array_max(F.array(*[choice(d) for d in range(n)]))
    return stats.select("cell", best.alias("b")).where("b.n_cuts > 0").select("cell", "b.d", "b.cuts")


def _bounded_cells(points: DataFrame, eps: float, n: int, scratch: Scratch) -> DataFrame:
    """(cell, id, y): every two similar points share a cell; cells with one point are left out.

    No cell has more than ``_CELL_ROWS`` points unless all its features spread
    over less than ``2 * _SLAB`` eps.
    """
    spread = points.agg(*[F.coalesce(F.stddev_pop(F.col("y")[d]), F.lit(0.0)) for d in range(n)]).first()
    features = sorted(range(n), key=lambda d: (-spread[d], d))[:_GRID_FEATURES]
    placed = scratch.keep(points.select("id", "y", F.explode(_cells(F.col("y"), features, _WIDTH, eps)).alias("cell")), "cells0")
    done = []
    for k in range(1, _MAX_CUTS + 1):
        counts = scratch.keep(placed.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1"), f"counts{k}")
        crowded = counts.where(F.col("c") > _CELL_ROWS)
        if k == _MAX_CUTS or crowded.isEmpty():
            done.append(placed.join(counts.select("cell"), "cell", "left_semi"))
            break
        slabs = scratch.keep(_slabs(placed, crowded, eps, n), f"slabs{k}")
        done.append(placed.join(counts.select("cell"), "cell", "left_semi").join(slabs.select("cell"), "cell", "left_anti"))
        v = F.element_at("y", F.col("d") + 1)
        below = lambda s: F.size(F.filter("cuts", lambda c: c < v + s * eps / 2 * (1 + 1e-9)))
        cut = placed.join(slabs, "cell").select("id", "y", "cell", "d", F.explode(F.sequence(below(-1), below(1))).alias("slab"))
        placed = scratch.keep(cut.select("id", "y", F.xxhash64("cell", "d", "slab").alias("cell")), f"cells{k}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part.select(out.columns))
    return out


def _links(points: DataFrame, eps: float, n: int, scratch: Scratch) -> DataFrame:
    """(u, v): links of each cell's local components."""
    cells = _bounded_cells(points, eps, n, scratch)
    buckets = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * points.count() // _BUCKET_ROWS + 1)

    def run(table: pa.Table) -> pa.Table:
        cell, ids = table["cell"].to_numpy(), table["id"].to_numpy()
        y = table["y"].combine_chunks().flatten().to_numpy().reshape(-1, n)
        order = np.argsort(cell, kind="stable")
        us, vs = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            for c in local_components(y[rows], eps):
                m = np.sort(ids[rows[c]])
                us.append(np.full(len(m) - 1, m[0]))
                vs.append(m[1:])
        cat = lambda a: np.concatenate(a) if a else np.empty(0, np.int64)
        return pa.table({"u": pa.array(cat(us)), "v": pa.array(cat(vs))})

    return cells.withColumn("bucket", F.pmod("cell", F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(run, "u long, v long").distinct()


def _propagate(links: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """(id, label): minimum labels over links, with a jump to the label's own label in each round."""
    both = scratch.keep(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    labels = scratch.keep(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("v")).select("id", F.least("id", "v").alias("label")), "labels")
    for _ in range(max_rounds):
        told = both.join(labels.select(F.col("id").alias("u"), "label"), "u").groupBy(F.col("v").alias("id")).agg(F.min("label").alias("told"))
        step = labels.join(told, "id").select("id", F.col("label").alias("old"), F.least("label", "told").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        new = scratch.keep(new, "next")
        changed = new.where("old <> label").limit(1).count()
        labels = scratch.keep(new.select("id", "label"), "labels")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def _assigned(df: DataFrame, id_column: str, x_column: str, eps: float, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Points (id, w, y, point) with their label, and rows with their point."""
    rows = scratch.keep(
        df.where((F.size(x_column) == n) & F.col(id_column).isNotNull())
        .select(F.col(id_column).alias("row_id"), scaled(F.col(x_column)).alias("y"))
        .withColumn("point", F.md5(F.to_json("y"))),
        "rows",
    )
    points = scratch.keep(rows.groupBy("point").agg(F.min("row_id").alias("id"), F.count("*").alias("w"), F.first("y").alias("y")), "points")
    links = scratch.keep(_links(points.select("id", "y"), eps, n, scratch), "links")
    labels = _propagate(links, scratch)
    scratch.hold("rows", "points", "labels")
    return points.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), rows


def mutual_clusters(
    df: DataFrame, id_column: str = "row_id", x_column: str = "x", eps: float = EPS, min_size: int = 5, n_features: int = N_FEATURES
) -> DataFrame:
    """(cluster_row_id, row_id): sets of at least ``min_size`` mutually similar rows that are similar to no row outside.

    Rows without identifier, or whose vector is null or has another length, take no part. Repeated
    vectors count with all their rows. An empty table gives no rows.
    """
    with Scratch(df.sparkSession) as scratch:
        points, rows = _assigned(df, id_column, x_column, eps, n_features, scratch)
    ranges = [(F.max(F.col("y")[d]) - F.min(F.col("y")[d])) <= eps for d in range(n_features)]
    whole = ranges[0]
    for r in ranges[1:]:
        whole = whole & r
    sets = points.groupBy("label").agg(F.sum("w").alias("size"), whole.alias("mutual")).where((F.col("size") >= min_size) & F.col("mutual"))
    members = points.join(sets.select("label"), "label", "left_semi").select("point", F.col("label").alias("cluster_row_id"))
    return rows.select("row_id", "point").join(members, "point").select("cluster_row_id", "row_id")


def described_clusters(
    df: DataFrame, id_column: str = "row_id", x_column: str = "x", name_column: str = "address", eps: float = EPS, n_features: int = N_FEATURES, typical: int = 3
) -> DataFrame:
    """(cluster_row_id, n_rows, n_cells, densest_rows, typical): every group of linked rows with at least two rows.

    ``typical`` are up to that many names, in order, from the densest cell of
    the cluster in a grid of width ``eps`` (of equally dense ones the first).
    Rows similar to no other row are clusters of their own and not listed.
    """
    with Scratch(df.sparkSession) as scratch:
        points, rows = _assigned(df, id_column, x_column, eps, n_features, scratch)
    cell = F.xxhash64(F.transform("y", lambda v: F.floor(v / eps + 0.5)))
    placed = points.select("point", "label", "w", cell.alias("cell"))
    cells = placed.groupBy("label", "cell").agg(F.sum("w").alias("n"))
    best = (
        cells.groupBy("label")
        .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_cells"), F.max("n").alias("densest_rows"), F.max_by("cell", F.struct("n", -F.col("cell"))).alias("cell"))
        .where("n_rows > 1")
    )
    dense = placed.join(best.select("label", "cell"), ["label", "cell"], "left_semi").select("point", "label")
    named = df.select(F.col(id_column).alias("row_id"), F.col(name_column).alias("name"))
    own = rows.select("row_id", "point").join(dense, "point").join(named, "row_id").where("name is not null").select("label", "name").distinct()
    # the rank limit is applied in each task before the shuffle
    first = own.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy("name"))).where(F.col("r") <= typical)
    names = first.groupBy("label").agg(F.sort_array(F.collect_list("name")).alias("typical"))
    return best.join(names, "label", "left").select(F.col("label").alias("cluster_row_id"), "n_rows", "n_cells", "densest_rows", "typical")
