"""Filling containers of fixed capacity with items of varying length.

The plan is made on the histogram of lengths, which has at most ``capacity``
entries however many items there are. A configuration is a multiset of lengths
that fits a container. The configuration linear program (fewest containers that
cover the histogram) is solved approximately by multiplicative weights: every
length has a weight that falls as it gets covered, and a knapsack dynamic
program prices configurations under these weights, until every length is covered
in full. Rounding carries the fractions of the shares on from configuration to
configuration. Where rounding up left fewer items of a length than a configuration
names, the largest lengths that still fit take the place, of those that rounding
down left over. What then remains, and only that, is packed by the same pricing
with real lengths as weights, a configuration at a time with its largest
multiplicity. The average of the dual weights, raised until every length is in
some full-priced configuration, gives a lower bound on the number of containers,
so the distance from the optimum is known.

The items are then numbered within their length, and intervals of these numbers
are mapped to containers. The number within a length needs no group of a whole
length in one task: lengths are salted, and the offsets of the salts added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm.bpe import TOKENIZER_DIR, count_tokens
from tallyweave.session import Scratch

CAPACITY = 2048
_SALT_ROWS = 200_000
_WASTE = 1 / 128  # a rounded configuration may leave so much room, if it does not leave far more by itself
_TOLERANCE = 0.05  # a configuration counts as best within this share of the best price


# --------------------------------------------------------------------------- plan on the histogram
@dataclass
class Plan:
    """Runs of items: items ``first`` .. of a length go to containers from ``start`` on, ``per`` to each."""

    length: np.ndarray
    first: np.ndarray
    start: np.ndarray
    per: np.ndarray
    containers: int
    bound: int
    by_shares: int = 0  # containers filled by the rounded shares; the others are full lengths and the remainder
    full: int = 0
    configurations: int = 0


def _best_fill(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value and last item by capacity used at most."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for w in range(int(sizes[0]), capacity + 1):
        k = np.searchsorted(sizes, w, side="right")
        gain = best[w - sizes[:k]] + value[:k]
        j = int(gain.argmax())
        if gain[j] > best[w - 1]:
            best[w], last[w] = gain[j], j
        else:
            best[w] = best[w - 1]
    return best, last


def _read_back(last: np.ndarray, sizes: np.ndarray, have: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of a filled table, each length at most as often as there are items."""
    config: dict[int, int] = {}
    w = capacity
    while w > 0:
        j = int(last[w])
        if j < 0:
            w -= 1
            continue
        config[j] = config.get(j, 0) + 1
        w -= int(sizes[j])
    return {j: min(n, int(have[j])) for j, n in config.items() if have[j] > 0}


def _fillers(room: int, sizes: np.ndarray, have: np.ndarray) -> dict[int, int]:
    """The largest lengths that still fit a room, each as often as it does."""
    more: dict[int, int] = {}
    alive = np.flatnonzero(have)
    while room > 0:
        alive = alive[: int(np.searchsorted(sizes[alive], room, side="right"))]
        if not alive.size:
            break
        j, alive = int(alive[-1]), alive[:-1]
        more[j] = min(room // int(sizes[j]), int(have[j]))
        room -= more[j] * int(sizes[j])
    return more


def _room(config: dict[int, int], sizes: np.ndarray, capacity: int) -> int:
    return capacity - sum(int(sizes[j]) * n for j, n in config.items())


def _top_up(config: dict[int, int], sizes: np.ndarray, have: np.ndarray, capacity: int) -> dict[int, int]:
    """Fill what room is left with the largest lengths that still fit."""
    left = have.copy()
    for j, n in config.items():
        left[j] -= n
    for j, n in _fillers(_room(config, sizes, capacity), sizes, np.maximum(left, 0)).items():
        config[j] = config.get(j, 0) + n
    return config


def _prices(dense: np.ndarray) -> np.ndarray:
    """Unbounded knapsack: best value by capacity used at most, from values by length (-inf where there is none)."""
    capacity = len(dense) - 1
    best, back = np.zeros(capacity + 1), np.zeros(capacity + 1)  # back[capacity - w] is best[w]
    for w in range(1, capacity + 1):
        best[w] = back[capacity - w] = max(best[w - 1], (dense[1 : w + 1] + back[capacity - w + 1 :]).max())
    return best


def _bound_of(weight: np.ndarray, sizes: np.ndarray, total: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """What the items weigh by the heaviest configuration, a lower bound on containers; and the table of prices."""
    dense = np.full(capacity + 1, -np.inf)
    dense[sizes] = weight
    best = _prices(dense)
    return float((weight * total).sum() / best[capacity]) if best[capacity] > 0 else 0.0, best


def _raised_bound(weight: np.ndarray, sizes: np.ndarray, total: np.ndarray, capacity: int, steps: int = 25) -> float:
    """The best bound while each length is raised by a part of what its best configuration lacks of the heaviest."""
    part = 1.0 / min(3, max(1, capacity // int(sizes[0])))
    most = 0.0
    for _ in range(steps):
        bound, best = _bound_of(weight, sizes, total, capacity)
        most = max(most, bound)
        weight = weight + part * (best[capacity] - (weight + best[capacity - sizes]))
    return most


def _plain_bound(sizes: np.ndarray, total: np.ndarray, capacity: int) -> float:
    """By size, and by size rounded down to k parts of a container (a dual feasible function for every k)."""
    bounds = [float((sizes * total).sum() / capacity)]
    for k in range(1, 9):
        x = (k + 1) * sizes
        bounds.append(float((np.where(x % capacity == 0, sizes / capacity, (x // capacity) / k) * total).sum()))
    return max(bounds)


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int | None = None) -> tuple[dict[tuple[tuple[int, int], ...], float], np.ndarray, float]:
    """Shares of configurations, the covered part of each length, and a lower bound on containers.

    One table prices the configurations of a round, the best one around each
    length; those whose value falls short by then wait for the next table. A
    step covers 1 / log(lengths + 1) of a length at most, so each finishes one
    such part of a length at least: the number of steps is bounded, and without
    ``rounds`` it ends when every length is covered. A covered length leaves.
    """
    total = counts.astype(float)
    eta = np.log(len(sizes) + 1.0)
    covered = np.zeros(len(sizes))
    shares: dict[tuple[tuple[int, int], ...], float] = {}
    bound, done = _plain_bound(sizes, total, capacity), 0
    average = np.zeros(len(sizes))
    index = np.zeros(capacity + 1, np.int64)
    index[sizes] = np.arange(len(sizes))
    while covered.min(initial=1) < 1 and (rounds is None or done < rounds):
        done += 1
        weight = np.where(covered < 1, sizes * np.exp(-eta * (covered - covered.min())), 0.0)
        dense = np.full(capacity + 1, -np.inf)
        dense[sizes[covered < 1]] = weight[covered < 1]
        best = _prices(dense)
        back = best[::-1].copy()
        bound = max(bound, float((weight * total).sum() / best[capacity]))
        average += weight / best[capacity]
        least = (1 - _TOLERANCE) * best[capacity]

        def around(j: int, least: float) -> tuple[float, dict[int, int]]:
            """Value and configuration around a length by the table; empty as soon as it must fall short."""
            config, barred = {j: 1}, []
            room, value, pick = capacity - int(sizes[j]), float(dense[sizes[j]]), j
            while room > 0 and best[room] > 0 and value + best[room] >= least:
                if config[pick] >= counts[pick]:
                    barred.append((int(sizes[pick]), float(dense[sizes[pick]])))
                    dense[sizes[pick]] = -np.inf
                gain = dense[1 : room + 1] + back[capacity - room + 1 :]
                size = room - int(gain[::-1].argmax())  # the largest of equals
                if gain[size - 1] == -np.inf:
                    break
                pick = int(index[size])
                config[pick] = config.get(pick, 0) + 1
                room -= size
                value += float(dense[size])
            for size, v in barred:
                dense[size] = v
            return (value, config) if value >= least else (value, {})

        def use(config: dict[int, int]) -> None:
            k, n = np.array(list(config)), np.array(list(config.values()), float)
            step = float((np.minimum(1 / eta, 1 - covered[k]) * total[k] / n).min())
            covered[k] += step * n / total[k]
            covered[k[covered[k] > 1 - 1e-9]] = 1.0
            dense[sizes[k]] = np.where(covered[k] < 1, dense[sizes[k]] * np.exp(-eta * step * n / total[k]), -np.inf)
            key = tuple(sorted(config.items(), reverse=True))
            shares[key] = shares.get(key, 0.0) + step

        used = False
        for j in np.argsort(covered, kind="stable").tolist():
            while covered[j] < 1 and dense[sizes[j]] + best[capacity - sizes[j]] >= least:
                config = around(j, least)[1]
                if not config:
                    break
                use(config)
                used = True
        if not used:  # what there is of the lengths does not make up the best price
            use(max((around(j, 0.0) for j in np.flatnonzero(covered < 1).tolist()), key=lambda x: x[0])[1])
    if done:
        bound = max(bound, _raised_bound(average, sizes, total, capacity))
    return shares, covered, bound


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int | None = None) -> tuple[list[tuple[dict[int, int], int]], int, int]:
    """Configurations (by index into ``sizes``, ascending) with multiplicities, a lower bound on containers, and how many of the first are by shares."""
    have = counts.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []
    if not len(sizes):
        return plan, 0, 0
    shares, _, bound = fractional(sizes, counts, capacity, rounds)
    # rounding: neighbours have their largest lengths in common, so a fraction carried on is missed little
    carried, rounded, planned = 0.0, [], np.zeros(len(sizes), np.int64)
    for key, share in sorted(shares.items(), reverse=True):
        carried += share
        times = int(carried + 0.5)
        carried -= times
        if times > 0:
            rounded.append((key, times))
            for j, n in key:
                planned[j] += n * times
    spare = np.maximum(have - planned, 0)  # what no rounded configuration names
    for key, left in rounded:
        while left > 0:
            config = {j: min(n, int(have[j])) for j, n in key if have[j] > 0}
            lack = _room(config, sizes, capacity)
            more = _fillers(lack, sizes, spare) if lack else {}
            if not config or lack - sum(int(sizes[j]) * n for j, n in more.items()) > max(int(capacity * _WASTE), _room(dict(key), sizes, capacity)):
                break  # too much of it is gone: the remainder takes what there is
            times = min([left, *(int(have[j]) // n for j, n in config.items()), *(int(spare[j]) // n for j, n in more.items())])
            for j, n in more.items():
                spare[j] -= n * times
                config[j] = config.get(j, 0) + n
            plan.append((config, times))
            left -= times
            for j, n in config.items():
                have[j] -= n * times
    by_shares = sum(times for _, times in plan)
    # the rest: the largest length with the largest that still fit, or where that leaves room, the
    # configuration that the pricing finds among what is left; as often as it goes, so each step uses up a length
    while have.any():
        top = int(np.flatnonzero(have)[-1])
        config = _top_up({top: 1}, sizes, have, capacity)
        if capacity - sum(int(sizes[j]) * n for j, n in config.items()) > capacity >> 9:
            alive = np.flatnonzero(have)
            s = sizes[alive]
            _, last = _best_fill(s * (1 + s / (8.0 * capacity)), s, capacity)
            config = {int(alive[j]): n for j, n in _top_up(_read_back(last, s, have[alive], capacity), s, have[alive], capacity).items()}
        times = min(int(have[j]) // n for j, n in config.items())
        plan.append((config, times))
        for j, n in config.items():
            have[j] -= n * times
    return plan, int(np.ceil(bound - 1e-6)), by_shares


def make_plan(histogram: dict[int, int], capacity: int, rounds: int | None = None) -> Plan:
    """Containers for all items of a histogram {length: items}; whole containers are left as they are."""
    sizes = np.array(sorted(k for k in histogram if 0 < k < capacity), np.int64)
    counts = np.array([histogram[int(k)] for k in sizes], np.int64)
    configs, bound, by_shares = solve(sizes, counts, capacity, rounds)
    used = np.zeros(len(sizes), np.int64)
    rows, at = [], 0
    for config, times in configs:
        for j, n in config.items():
            rows.append((int(sizes[j]), int(used[j]), at, n))
            used[j] += n * times
        at += times
    full = histogram.get(capacity, 0)  # a piece of the whole capacity needs no plan
    if full:
        rows.append((capacity, 0, at, 1))
        at += full
    rows.sort()
    cols = [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.empty(0, np.int64)] * 4
    return Plan(*cols, containers=at, bound=bound + full, by_shares=by_shares, full=full, configurations=len(configs))


# --------------------------------------------------------------------------- items
def pieces_of(lengths: DataFrame, capacity: int, id_column: str = "doc_id", size_column: str = "n_tokens") -> DataFrame:
    """(<id>, piece_no, n_tokens): items longer than the capacity are cut into full pieces and a rest."""
    n = F.col(size_column)
    last = F.greatest(F.ceil(n / F.lit(capacity)) - 1, F.lit(0)).cast("int")
    return lengths.select(id_column, n, F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        id_column, "piece_no", F.least(n - F.col("piece_no") * capacity, F.lit(capacity)).cast("long").alias("n_tokens")
    )


def _planned(df: DataFrame, id_column: str, text_column: str, capacity: int, tokenizer_dir: str, rounds: int | None) -> tuple[DataFrame, Plan]:
    """The packed pieces and the plan they follow."""
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        items = scratch.keep(pieces_of(count_tokens(df, id_column, text_column, tokenizer_dir), capacity, id_column), "pieces")
        scratch.hold("pieces")
    histogram = {int(r[0]): int(r[1]) for r in items.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    plan = make_plan(histogram, capacity, rounds)

    salts = max(1, max(histogram.values(), default=0) // _SALT_ROWS + 1)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(id_column, "piece_no"), F.lit(salts)).cast("int"))
    # offsets of the salts within each length: capacity x salts rows at most, so a small window
    before = W.partitionBy("n_tokens").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("n_tokens", "_salt").agg(F.count("*").alias("_n")).select("n_tokens", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = W.partitionBy("n_tokens", "_salt").orderBy(id_column, "piece_no")
    numbered = salted.withColumn("_rn", F.row_number().over(local) - 1)
    if salts > 1:
        numbered = numbered.join(offsets, ["n_tokens", "_salt"]).withColumn("_rn", F.col("_rn") + F.col("_off"))

    shared = spark.sparkContext.broadcast((plan.length * (1 << 42) + plan.first, plan.first, plan.start, plan.per))
    kind = df.schema[id_column].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, start, per = shared.value
        for b in batches:
            size, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            if len(keys):
                run = np.maximum(np.searchsorted(keys, size * (1 << 42) + rank, side="right") - 1, 0)
                where = np.where(size > 0, start[run] + (rank - first[run]) // per[run], 0)
            else:
                where = np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(where)], [id_column, "piece_no", "n_tokens", "container"])

    packed = numbered.select(id_column, "piece_no", "n_tokens", F.col("_rn").cast("long").alias("_rn")).mapInArrow(
        assign, f"`{id_column}` {kind}, piece_no int, n_tokens long, container long"
    )
    return packed, plan


def pack(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, tokenizer_dir: str = TOKENIZER_DIR, rounds: int | None = None) -> DataFrame:
    """(<id>, piece_no, n_tokens, container): every text's pieces and their containers.

    No container holds more than ``capacity`` tokens. A text is divided only if
    it is longer than that. Null and empty texts have one piece of 0 tokens,
    which takes no room and lies in container 0. Rows with equal ids are items
    of their own, which may then have equal ids and pieces in the result; ties
    in length are placed by id. Other columns are not read, and an empty table
    gives no rows.
    """
    return _planned(df, id_column, text_column, capacity, tokenizer_dir, rounds)[0]


def report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, tokenizer_dir: str = TOKENIZER_DIR, rounds: int | None = None) -> DataFrame:
    """One row: how well the texts of ``pack`` fill their containers, and which step filled them.

    containers, tokens, filled (share of the room used); least_containers by
    plain size and lower_bound by the dual weights; of the containers,
    by_program (rounded shares of the linear program), by_full (full pieces,
    which need no plan) and by_remainder; n_configurations that the plan uses.
    An empty table gives a row of zeros.
    """
    packed, plan = _planned(df, id_column, text_column, capacity, tokenizer_dir, rounds)
    return packed.agg(F.count_distinct("container").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).select(
        "containers",
        "tokens",
        (F.col("tokens") / F.greatest(F.col("containers") * capacity, F.lit(1))).alias("filled"),
        F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        *[F.lit(int(v)).cast("long").alias(c) for c, v in (
            ("lower_bound", plan.bound), ("by_program", plan.by_shares), ("by_full", plan.full), ("by_remainder", plan.containers - plan.by_shares - plan.full), ("n_configurations", plan.configurations),
        )],
    )
