"""Distinct counts of huge identifier sets from mergeable hash runs.

An identifier is its 64-bit hash. A set is stored as runs: sorted hashes of one
slice of the hash range, coded as variable-length differences. Every task turns
its rows into runs, so what is shuffled are coded hashes without repetitions;
the runs of a slice are merged by union, over tasks, batches or days. Slices
partition the hash range, so counts add up over slices, and no task ever holds
more than a slice, however large one group is.

Error: two identifiers may share a hash. Of n distinct identifiers the expected
number of such pairs is at most n(n-1)/2 / 2^64; it bounds the expected
undercount and, by the birthday bound, the chance that the count is not exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("day_no", "source", "side")
_RUNS = "slice int, day_no long, source string, side string, n long, run binary"
_FLUSH = 4_000_000
_SLICE_VALUES = 4_000_000


# --------------------------------------------------------------------------- runs
def encode_run(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 as differences of 7 bits a byte, low bits first."""
    if not values.size:
        return b""
    d = np.diff(values, prepend=np.uint64(0))
    size = np.ones(d.size, np.int64)
    for k in range(1, 10):
        size += d >= np.uint64(1 << (7 * k))
    end = np.cumsum(size)
    out = np.zeros(end[-1], np.uint8)
    start = end - size
    for k in range(int(size.max())):
        has = size > k
        out[start[has] + k] = ((d[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[has] > k + 1) * 128).astype(np.uint8)
    return out.tobytes()


def decode_run(run: bytes) -> np.ndarray:
    b = np.frombuffer(run, np.uint8)
    if not b.size:
        return np.empty(0, np.uint64)
    last = b < 128
    start = np.r_[0, np.flatnonzero(last)[:-1] + 1]
    place = np.arange(b.size) - np.repeat(start, np.diff(np.r_[start, b.size]))
    parts = (b & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.cumsum(np.add.reduceat(parts, start), dtype=np.uint64)


def union_runs(runs: list[np.ndarray]) -> np.ndarray:
    """k-way union of sorted distinct arrays: a merge sort takes the runs as they are."""
    if len(runs) == 1:
        return runs[0]
    both = np.sort(np.concatenate(runs), kind="stable")
    return both[np.r_[True, both[1:] != both[:-1]]] if both.size else both


# --------------------------------------------------------------------------- Spark steps
def _hashes(column: str) -> Column:
    # the member's own array, so that the scan reads no other member
    addresses = F.coalesce(F.col(f"{column}.address"), F.array().cast("array<string>"))
    return F.transform(F.filter(addresses, lambda a: a != ""), lambda a: F.xxhash64(a))


def slices_for(spark, values: int) -> int:
    """Number of slices: a slice's values fit a task's memory at any size of the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), values // _SLICE_VALUES + 1)


def task_runs(tx: DataFrame, slices: int) -> DataFrame:
    """Runs of each task: of each day, source, side and slice of the address hashes."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        rows = []
        for (day, source, side), parts in held.items():
            v = np.unique(np.concatenate(parts))
            # the slice is the hash's place in the range, so a slice's values are neighbours
            at = np.searchsorted((v >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32), np.arange(slices + 1, dtype=np.uint64))
            rows += [(s, day, source, side, int(b - a), encode_run(v[a:b])) for s, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["slice", *KEYS, "n", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(list)
        size = 0
        for b in batches:
            # text, as nulls in a table of keys would turn days into floats
            key = pd.Series(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), dtype=object)
            code, names = pd.factorize(key)
            for side, column in (("in", b.column(2)), ("out", b.column(3))):
                lengths = np.diff(column.offsets.to_numpy())
                values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(code, lengths)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(len(names) + 1))
                for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if z > a:
                        held[(*names[k], side)].append(values[order[a:z]])
                size += len(values)
            if size >= _FLUSH:
                yield from flush(held)
                held, size = defaultdict(list), 0
        yield from flush(held)

    rows = tx.select(
        F.expr("block_height div 144").alias("day_no"), F.col("provenance.source").alias("source"), _hashes("inputs").alias("i"), _hashes("outputs").alias("o")
    )
    return rows.mapInArrow(run, _RUNS)


def _by_key(table: pa.Table) -> dict[tuple, np.ndarray]:
    held: dict = defaultdict(list)
    for day, source, side, run in zip(*(table[c].to_pylist() for c in (*KEYS, "run"))):
        held[day, source, side].append(decode_run(run))
    return {k: union_runs(v) for k, v in held.items()}


def merge_runs(runs: DataFrame) -> DataFrame:
    """The union of runs of any number of tasks, batches or stored tables (of one slicing)."""

    def merge(table: pa.Table) -> pa.Table:
        s = table["slice"][0].as_py() if table.num_rows else 0
        rows = [(s, *k, len(v), encode_run(v)) for k, v in _by_key(table).items()]
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["slice", *KEYS, "n", "run"])

    return runs.groupBy("slice").applyInArrow(merge, _RUNS)


def count_runs(runs: DataFrame, groupings: list[tuple[str, ...]]) -> DataFrame:
    """(grouping, day_no, source, side, n_distinct, error_bound) for each grouping of the keys.

    Columns outside a grouping are null; ``grouping`` names those inside, so a
    null key is told from a column summed over. The runs of a slice are merged
    and counted for all groupings in one task; the counts add up over slices.
    """

    def count(table: pa.Table) -> pa.Table:
        finest = _by_key(table)
        rows = []
        for g in groupings:
            inside = [k in g for k in KEYS]
            groups: dict = defaultdict(list)
            for key, v in finest.items():
                groups[tuple(x if i else None for x, i in zip(key, inside))].append(v)
            rows += [(",".join(g), *key, len(union_runs(v))) for key, v in groups.items()]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        cols = list(zip(*rows)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["grouping", *KEYS, "n"])

    n = F.col("n_distinct").cast("double")
    return (
        runs.groupBy("slice")
        .applyInArrow(count, "grouping string, day_no long, source string, side string, n long")
        .groupBy("grouping", *KEYS)
        .agg(F.sum("n").alias("n_distinct"))
        .withColumn("error_bound", F.least(n * (n - 1) / 2 / F.lit(2.0**64), F.lit(1.0)))
    )


def distinct_addresses(tx: DataFrame, groupings: list[tuple[str, ...]]) -> DataFrame:
    """Distinct addresses of ``tx`` by day, source and side, and their combinations.

    Null and empty addresses are not counted; rows with a null day or source
    form groups of their own. Groups without any address give no row, nor does
    an empty table. Null lists and elements count as absent, repeated rows add
    nothing, and other columns are not read.
    """
    return count_runs(task_runs(tx, slices_for(tx.sparkSession, 5 * tx.count())), groupings)
