"""Orders within groups of any size: ranks, running values and percentiles by range partitions.

A window over a group puts the group into one task. Here rows are partitioned by
ranges of (group, order) instead, so a group with a third of all rows is spread
over a third of the partitions; what a partition leaves to the later ones of
its group is one row. The partitioned table is written, as range borders are
drawn from a sample and a second draw could give others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.session import Scratch


def ranged(rows: DataFrame, by: list[Column], scratch: Scratch, name: str = "ranged") -> DataFrame:
    """The rows with the number ``part`` of their range partition, written; as many as the session's shuffle partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = scratch.keep(rows.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()), name)
    scratch.hold(name)
    return out


def percentiles(rows: DataFrame, group: list[str], columns: list[str], p: float, scratch: Scratch) -> DataFrame:
    """The group, its ``size`` and the exact percentile (linear between neighbours) of each column; nulls don't count.

    Equal values are counted in each task before anything is ordered. Groups
    without a value of a column have null there.
    """
    tall = rows.select(*group, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("_x")).select(*group, "_x.c", "_x.v")
    counted = tall.where("v is not null").groupBy(*group, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    key = [*group, "c"]
    cut = ranged(counted, [F.col(k) for k in (*key, "v")], scratch, "percentile_ranges")
    sums = cut.groupBy(*key, "part").agg(F.sum("n").alias("own"))
    before = W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # one row for each group and part
    offsets = scratch.keep(sums.select(*key, "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(W.partitionBy(*key)).alias("total")), "percentile_offsets")
    scratch.hold("percentile_offsets")
    local = W.partitionBy("part", *key).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    at = F.lit(p) * (F.col("total") - 1)
    upto = cut.withColumn("upto", F.sum("n").over(local))
    same = [upto[k].eqNullSafe(offsets[k]) for k in (*key, "part")]
    placed = upto.join(offsets, same).select(*[upto[k] for k in (*key, "v", "n", "upto")], "before", "total")
    last = F.col("upto") + F.col("before") - 1  # places of this value: last - n + 1 .. last
    has = lambda place: (last >= place) & (last - F.col("n") < place)
    found = placed.groupBy(*key).agg(F.max(F.when(has(F.floor(at)), F.col("v"))).alias("lo"), F.max(F.when(has(F.ceil(at)), F.col("v"))).alias("hi"), F.max(at - F.floor(at)).alias("f"))
    value = F.col("lo") * (1 - F.col("f")) + F.col("hi") * F.col("f")
    wide = found.groupBy(*group).agg(*[F.max(F.when(F.col("c") == i, value)).alias(c) for i, c in enumerate(columns)])
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(wide, [sizes[g].eqNullSafe(wide[g]) for g in group], "left").select(*[sizes[g] for g in group], "size", *columns)
