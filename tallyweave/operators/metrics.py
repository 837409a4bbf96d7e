"""Agreement of a score with labels. Input rows have y (0/1), score and a row order ``pos`` that breaks ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.operators.ranks import ranged
from tallyweave.session import Scratch


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    y, p = F.col("y") == 1, F.col("score") >= threshold
    return rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def prf(conf: DataFrame) -> DataFrame:
    c = F.col
    precision, recall = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    return conf.select(
        "*", F.bround(precision, 4).alias("precision"), F.bround(recall, 4).alias("recall"), F.bround(ratio(2 * precision * recall, precision + recall), 4).alias("f1")
    )


def youden_j(conf: DataFrame) -> DataFrame:
    c = F.col
    return conf.select(F.bround(ratio(c("tp"), c("tp") + c("fn")) - ratio(c("fp"), c("fp") + c("tn")), 4).alias("youden_j"))


def ranked(rows: DataFrame) -> DataFrame:
    """y, rank and running positives, by score downwards and ``pos``, without sorting all rows in one task.

    Rows are range-partitioned by score, once and for all; rank and running sum
    are local ones plus the totals of the partitions before, one row per partition.
    """
    with Scratch(rows.sparkSession) as scratch:
        part = ranged(rows.select("pos", "y", "score"), [F.col("score").desc(), F.col("pos")], scratch, "by_score")
        local = W.partitionBy("part").orderBy(F.col("score").desc(), F.col("pos"))
        own = part.withColumn("r", F.row_number().over(local)).withColumn("t", F.sum("y").over(local.rowsBetween(W.unboundedPreceding, 0)))
        sizes = part.groupBy("part").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
        # one row per partition: their order fits one task
        before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("dn"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("dp"))
        return own.join(offsets, "part").select("pos", "y", "score", (F.col("r") + F.col("dn")).alias("rank"), (F.col("t") + F.col("dp")).alias("tp"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Step-wise area under precision and recall, ties in row order; 0 without positives."""
    hits = ranked(rows).agg(F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("rank"))).alias("s"), F.sum("y").alias("p"))
    return hits.select(F.bround(F.coalesce(ratio(F.col("s"), F.col("p")), F.lit(0.0)), 4).alias("average_precision"))


def precision_at(rows: DataFrame, ks: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """(k, precision, hits) of the first k rows; k is cut to the number of rows."""
    top = rows.orderBy(F.col("score").desc(), "pos").limit(max(ks))
    r = top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "pos")))  # max(ks) rows
    wide = r.select("y", "rank", F.explode(F.array(*map(F.lit, ks))).alias("asked")).where("rank <= asked")
    return wide.groupBy("asked").agg(F.count("*").alias("k"), F.sum("y").alias("hits")).select("asked", "k", F.bround(F.col("hits") / F.col("k"), 4).alias("precision"), "hits")


def evaluate(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row with all figures of a split. ``labelled_accuracy`` is for reference only: with few positives, a constant reaches nearly as much."""
    base = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_positive"))
    conf = confusion(rows, threshold)
    at = precision_at(rows)
    tops = at.agg(*[F.coalesce(F.max(F.when(F.col("asked") == k, F.col("precision"))), F.lit(0.0)).alias(f"precision_at_{k}") for k in (10, 20, 50, 100)])
    one = base.crossJoin(prf(conf)).crossJoin(youden_j(conf)).crossJoin(average_precision(rows)).crossJoin(tops)  # one row each
    return one.withColumn("base_rate", F.bround(ratio(F.col("n_positive"), F.col("n")), 4)).withColumn("labelled_accuracy", F.bround(ratio(F.col("tp") + F.col("tn"), F.col("n")), 4))


def best_threshold(rows: DataFrame, metric: str = "f1") -> DataFrame:
    """(threshold, score): the first of 0.05, 0.06 .. 0.95 with the largest f1 or, as ``metric`` says, the largest 'youden' index.

    Rows are counted by the number of thresholds they reach, so one pass and 92
    groups serve all candidates. Without positives it is 0.5 with score 0.
    """
    if metric not in ("f1", "youden"):
        raise ValueError(f"unknown metric: {metric}")
    steps = F.array(*[F.lit(round(0.05 + i / 100, 3)) for i in range(91)])
    reach = rows.select("y", F.size(F.filter(steps, lambda t: t <= F.col("score"))).alias("reach")).groupBy("reach").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    t = rows.sparkSession.range(91).select(F.col("id").cast("int").alias("i"), F.expr("round(0.05D + id / 100D, 3)").alias("threshold"))
    total = reach.agg(F.sum("p").alias("positives"), F.sum("n").alias("all"))
    # 91 candidates by at most 92 groups
    c = t.join(F.broadcast(reach), F.col("reach") > F.col("i"), "left").groupBy("threshold").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("hit"))
    c = c.crossJoin(F.broadcast(total))
    precision, recall = ratio(F.col("tp"), F.col("hit")), ratio(F.col("tp"), F.col("positives"))
    value = ratio(2 * precision * recall, precision + recall) if metric == "f1" else recall - ratio(F.col("hit") - F.col("tp"), F.col("all") - F.col("positives"))
    scored = c.select("threshold", F.bround(value, 4).alias("score"), "positives")
    best = scored.agg(F.max_by("threshold", F.struct("score", -F.col("threshold"))).alias("t"), F.max("score").alias("s"), F.max("positives").alias("p"))
    return best.select(F.when(F.col("p") > 0, F.col("t")).otherwise(0.5).alias("threshold"), F.when(F.col("p") > 0, F.col("s")).otherwise(0.0).alias("score"))
