"""Most frequent values with guaranteed count intervals, by lossy counting.

Each task counts its own values: it holds a count and the largest undercount of
every value it keeps, and at the end of a bucket drops the values that can't
have more than one occurrence per bucket. So a task holds O(1/epsilon · log)
entries however many distinct values there are. The summaries of the tasks are
merged by sums: a value's count is the sum of its counts, its undercount that of
its undercounts where it was kept and of the bucket numbers where it was not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import Scratch

_SUMMARY = "field string, value string, n long, slack long, seen long"


class LossyCounter:
    """Counts of one stream; ``entries`` maps a value to [count, largest undercount]."""

    def __init__(self, epsilon: float):
        self.width = max(1, int(np.ceil(1 / epsilon)))
        self.entries: dict[str, list[int]] = {}
        self.seen = 0
        self._pruned_at = 0

    @property
    def bucket(self) -> int:
        return self.seen // self.width

    def add(self, values: pa.Array) -> None:
        """Count an array of non-null values; they may span several buckets."""
        missed, entries = self._pruned_at, self.entries
        counted = pc.value_counts(values)
        for v, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
            e = entries.get(v)
            if e is None:
                entries[v] = [n, missed]
            else:
                e[0] += n
        self.seen += len(values)
        if self.bucket > self._pruned_at:
            b = self._pruned_at = self.bucket
            self.entries = {v: e for v, e in entries.items() if e[0] + e[1] > b}


def lossy_summaries(values: DataFrame, epsilon: float) -> DataFrame:
    """Mergeable summaries of (field, value): one row per kept value and task.

    ``n`` is the count, ``slack`` what the undercount of a kept value lies below
    the task's bucket number. One row with a null value per field and task has
    the number of values seen in ``seen`` and the bucket number in ``slack``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, LossyCounter] = {}
        for b in batches:
            fields = b.column(0)
            for f in pc.unique(fields).to_pylist():
                own = b.column(1).filter(pc.equal(fields, f))
                counters.setdefault(f, LossyCounter(epsilon)).add(own)
        for f, c in counters.items():
            # values that were never at a bucket's end still count in full
            top = c._pruned_at
            rows = [(f, v, n, top - d, 0) for v, (n, d) in c.entries.items()] + [(f, None, 0, top, c.seen)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["field", "value", "n", "slack", "seen"])

    return values.where("field is not null and value is not null").select(F.col("field").cast("string"), F.col("value").cast("string")).mapInArrow(run, _SUMMARY)


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """The union of summaries as one: (field, value, n, slack, seen)."""
    return summaries.groupBy("field", "value").agg(*[F.sum(c).alias(c) for c in ("n", "slack", "seen")])


def frequent(values: DataFrame, support: float, epsilon: float | None = None) -> DataFrame:
    """(field, value, count_low, count_high, n_values) of all values that can have ``support`` of their field.

    ``values`` has the columns field and value; nulls in either are left out.
    The true count lies within [count_low, count_high], and the interval is at
    most ``epsilon`` (a fifth of the support) of the field's values wide. Every
    value with the support is in the result, values of equal counts alike; every
    repeated row counts, empty strings are values, other columns are not read and
    an empty table gives no rows. The merged summaries, whose size
    doesn't grow with the distinct values, are written once to the shared folder.
    """
    epsilon = epsilon or support / 5
    merged = Scratch(values.sparkSession).keep(merge_summaries(lossy_summaries(values, epsilon)), "summaries")
    # a field's totals lie in its row with a null value
    totals = merged.where("value is null").select("field", F.col("slack").alias("_all"), F.col("seen").alias("n_values"))
    out = merged.where("value is not null").join(totals, "field")
    high = F.col("n") + F.col("_all") - F.col("slack")
    return out.select("field", "value", F.col("n").alias("count_low"), high.alias("count_high"), "n_values").where(F.col("count_high") >= F.col("n_values") * support)


def frequent_exact(values: DataFrame, support: float, epsilon: float | None = None) -> DataFrame:
    """(field, value, n, n_values): the values that make up at least ``support`` of their field, with exact counts.

    The candidates come from ``frequent``, so there are at most about
    1 / (support - epsilon) per field; they are collected (that bound holds
    whatever the data) and counted in one more pass. Nulls, repeated rows, other
    columns and empty tables are treated as there.
    """
    few = frequent(values, support, epsilon).select("field", "value", "n_values").collect()
    local = values.sparkSession.createDataFrame([tuple(r) for r in few], "field string, value string, n_values long")
    return (
        values.join(F.broadcast(local), ["field", "value"])
        .groupBy("field", "value", "n_values")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= F.col("n_values") * support)
        .select("field", "value", "n", "n_values")
    )
