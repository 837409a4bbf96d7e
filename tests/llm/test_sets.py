"""Frequent items, distinct runs, components and clusters against brute force."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import components, distinct_runs, grid_clusters, heavy_hitters
from tallyweave.session import Scratch


# --------------------------------------------------------------------------- frequent items
@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=400), st.integers(1, 60))
def test_lossy_guarantee(values, batch):
    c = heavy_hitters.LossyCounter(0.1)
    for i in range(0, len(values), batch):
        c.add(pa.array([str(v) for v in values[i : i + batch]]))
    true = Counter(map(str, values))
    for v, n in true.items():
        low, miss = c.entries.get(v, (0, c._pruned_at))
        assert low <= n <= low + miss
        assert miss <= 0.1 * len(values)


def skewed(spark, n):
    rnd = random.Random(5)
    rows = [("f", "hot" if rnd.random() < 0.3 else f"v{int(rnd.paretovariate(0.7))}", 1) for _ in range(n)] + [("g", f"u{i}", 1) for i in range(500)] + [(None, "x", 1), ("f", None, 1)] * 5
    return rows, spark.createDataFrame(rows, "field string, value string, n int").repartition(7)


def test_frequent_values(spark):
    rows, df = skewed(spark, 20_000)
    true = Counter((f, v) for f, v, _ in rows if f and v)
    size = Counter(f for f, v, _ in rows if f and v)
    got = {(r.field, r.value): r for r in heavy_hitters.frequent(df, 0.01).collect()}
    want = {k for k, n in true.items() if n >= 0.01 * size[k[0]]}
    assert want <= set(got)
    for k, r in got.items():
        assert r.count_low <= true[k] <= r.count_high and r.count_high - r.count_low <= 0.002 * size[k[0]] + 1 and r.n_values == size[k[0]]
    assert {(r.field, r.value): r.n for r in heavy_hitters.frequent_exact(df, 0.01).collect()} == {k: true[k] for k in want}
    assert heavy_hitters.frequent_exact(df.limit(0), 0.01).count() == 0


# --------------------------------------------------------------------------- distinct runs
@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=50), st.sets(st.integers(0, 300), max_size=20))
def test_run_round_trip(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert distinct_runs.decode_run(distinct_runs.encode_run(x)).tolist() == sorted(a)
    assert distinct_runs.union_runs([x, y]).tolist() == sorted(a | b)


TX = "block_height long, provenance struct<source: string>, inputs array<struct<address: string>>, outputs array<struct<address: string>>, n long, slice int"


def test_distinct_counts_and_merging(spark):
    rnd = random.Random(2)
    side = lambda: None if rnd.random() < 0.1 else [None if rnd.random() < 0.1 else (rnd.choice([None, "", *(f"a{i}" for i in range(60))]),) for _ in range(rnd.randrange(5))]
    rows = [(rnd.choice([None, rnd.randrange(600)]), rnd.choice([None, (None,), ("s",), ("t",)]), side(), side(), 1, 1) for _ in range(600)]
    df = spark.createDataFrame(rows, TX).repartition(5)
    groupings = [(), ("day_no",), ("source", "side"), ("day_no", "source", "side")]
    want = defaultdict(set)
    for h, p, i, o, *_ in rows:
        for s, items in (("in", i), ("out", o)):
            for e in items or []:
                if e and e[0]:
                    key = {"day_no": None if h is None else h // 144, "source": p and p[0], "side": s}
                    for g in groupings:
                        want[(",".join(g), *(key[k] if k in g else None for k in distinct_runs.KEYS))].add(e[0])
    read = lambda d: {(r.grouping, r.day_no, r.source, r.side): r.n_distinct for r in d.collect()}
    assert read(distinct_runs.distinct_addresses(df, groupings)) == {k: len(v) for k, v in want.items()}
    # partial results of two halves, merged and counted
    halves = [distinct_runs.task_runs(df.where(c), 6) for c in ("coalesce(block_height, 0) < 300", "block_height >= 300")]
    merged = distinct_runs.merge_runs(distinct_runs.merge_runs(halves[0]).unionByName(halves[1]))
    assert read(distinct_runs.count_runs(merged, groupings)) == {k: len(v) for k, v in want.items()}
    assert distinct_runs.distinct_addresses(df.limit(0), groupings).count() == 0


# --------------------------------------------------------------------------- components
def union_find(pairs):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(root)}


def test_components(spark):
    rnd = random.Random(4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    star = [("hub", f"s{i}") for i in range(80)]
    mixed = [(f"m{rnd.randrange(90)}", f"m{rnd.randrange(90)}") for _ in range(70)]
    pairs = chain + star + mixed + [("Z", "a"), ("é", "z"), ("a", "Z"), ("x", "x")]
    rnd.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, "q"), ("q", None)], "a string, b string")
    got = {r.address: r.group_address for r in components.groups(df).collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])
    assert components.groups(df.limit(0)).count() == 0


def test_co_spent(spark):
    rows = [([("A",), ("B",), None, (None,), ("",)],), ([("B",), ("C",), ("B",)],), ([("D",), ("D",)],), (None,), ([],), ([("E",)],)]
    df = spark.createDataFrame(rows, "inputs array<struct<address: string>>")
    assert sorted(map(tuple, components.co_spent(df).collect())) == [("A", "A"), ("A", "B"), ("A", "C")]


# --------------------------------------------------------------------------- clusters
def brute_clusters(rows, eps=0.05, n=19):
    ok = [(i, x) for i, x in rows if i is not None and x is not None and len(x) == n]
    v = np.array([[0 if e is None or not np.isfinite(e) else e for e in x] for _, x in ok])
    y = np.sign(v) * np.log1p(np.abs(v))
    near = (np.abs(y[:, None] - y[None]) <= eps).all(2)
    out = set()
    for i in range(len(ok)):
        own = np.flatnonzero(near[i])
        if len(own) >= 5 and all((near[j] == near[i]).all() for j in own):
            out.add((min(ok[j][0] for j in own), ok[i][0]))
    return sorted(out)


def feature_rows_of(seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(25):
        centre = rng.choice([0.0, 1.0, 5.0, -3.0], 19) * rng.random(19)
        for _ in range(rng.integers(1, 12)):
            y = np.log1p(np.abs(centre)) * np.sign(centre) + rng.uniform(-0.03, 0.03, 19)
            rows.append((k, (np.sign(y) * np.expm1(np.abs(y))).tolist()))
            k += 1
    for copies, x in ((7, [0.0] * 19), (3, [2.0] * 19), (5, [None, float("nan"), float("inf")] + [9.0] * 16)):
        rows += [(k + i, x) for i in range(copies)]
        k += copies
    return [*rows, (k, None), (k + 1, [1.0] * 5), (None, [0.0] * 19)]


SCHEMA = "row_id long, x array<double>, address string, cell long, label long"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, f"n{i}", 0, 0) for i, x in rows], SCHEMA)


def test_mutual_clusters(spark):
    rows = feature_rows_of(1)
    assert sorted(map(tuple, grid_clusters.mutual_clusters(frame(spark, rows)).collect())) == brute_clusters(rows)


def test_crowded_cells_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(grid_clusters, "_CELL_ROWS", 10)
    rows = feature_rows_of(2)
    assert sorted(map(tuple, grid_clusters.mutual_clusters(frame(spark, rows)).collect())) == brute_clusters(rows)


def test_described_clusters(spark):
    got = {r.cluster_row_id: r for r in grid_clusters.described_clusters(frame(spark, feature_rows_of(1))).collect()}
    zero = next(r for r in got.values() if r.n_rows >= 7 and r.densest_rows == 7)
    assert zero.n_cells == 1 and len(zero.typical) == 3
    empty = frame(spark, [(1, None)])
    assert grid_clusters.described_clusters(empty).count() == 0 and grid_clusters.mutual_clusters(empty).count() == 0


def cells_of(spark, y, eps=0.05):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, y array<double>")
    with Scratch(spark) as scratch:
        return grid_clusters._bounded_cells(df, eps, y.shape[1], scratch).select("cell", "id").toPandas()


def test_cells_are_bounded_and_share_neighbours(spark, monkeypatch):
    """Cut cells hold at most so many points, a point is in few cells, and every two similar points share one."""
    monkeypatch.setattr(grid_clusters, "_CELL_ROWS", 200)
    rng = np.random.default_rng(3)
    y = rng.uniform(0, 0.9, (3000, 4))
    y[:, 3] = 0.4
    got = cells_of(spark, y)
    assert got.groupby("cell").size().max() <= 200
    assert len(got) <= 6 * len(y) and got.groupby("id").size().max() <= 64
    near = np.argwhere(np.triu((np.abs(y[:, None] - y[None]) <= 0.05).all(2), 1))
    cells = got.groupby("id")["cell"].agg(set)
    assert len(near) > 500 and all(cells[i] & cells[j] for i, j in near)


def test_duplicates_are_bounded_at_the_borders(spark):
    """Values on the border of a cell in every feature: 2 ** 8 cells at worst."""
    got = cells_of(spark, np.full((3, 19), 0.5) + np.arange(3)[:, None] * 0.001)
    assert got.groupby("id").size().max() <= 2**grid_clusters._GRID_FEATURES


def test_a_hundred_thousand_points_in_one_cell():
    """No cut helps where all features spread over little: the search takes them in seconds."""
    rng = np.random.default_rng(5)
    y = rng.uniform(0, 0.125, (100_000, 19))
    began = time.time()
    parts = grid_clusters.local_components(y, 0.05)
    assert time.time() - began < 120
    parts.sort(key=len, reverse=True)
    assert len(parts[0]) > 95_000
    sample = rng.choice(parts[0], 300)
    inside = np.zeros(len(y), bool)
    inside[parts[0]] = True
    for p in sample:
        assert inside[(np.abs(y - y[p]) <= 0.05).all(1)].all()


def test_local_components():
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.uniform(0, 0.06, (300, 1)), axis=0).repeat(3, axis=1)
    got = sorted(sorted(c.tolist()) for c in grid_clusters.local_components(y, 0.05))
    cuts = np.flatnonzero(np.diff(y[:, 0]) > 0.05) + 1
    assert got == sorted(s.tolist() for s in np.split(np.arange(300), cuts) if len(s) > 1)
