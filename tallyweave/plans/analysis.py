"""The analysis of a window from features to ranking, and its document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import cohort, serving
from tallyweave.session import Scratch

TABLES = ("cohorts", "clusters", "counts", "labels", "scores", "ranking")


def analyse(features: DataFrame, edges: DataFrame, confirmed: DataFrame, max_points: int = 60_000) -> dict[str, DataFrame]:
    """Cohorts by density, their risk and counts, weak labels, scores and the ranking by score.

    Scores are those of the graph model, or the fallback's where there are too
    few rows or positives to fit one. A score agrees with weak labels; it ranks.
    """
    with Scratch(features.sparkSession) as scratch:
        scratch.hold(*TABLES, "features")
        f = scratch.keep(features, "features")
        cohorts = scratch.keep(cohort.cohorts(f, max_points=max_points), "cohorts")
        clusters = scratch.keep(cohort.cluster_risk(f, cohorts), "clusters")
        labels = scratch.keep(cohort.weak_labels(f, cohorts, clusters, confirmed), "labels")
        try:
            scores = cohort.graph_scores(f, edges, labels)
        except ValueError:
            scores = cohort.fallback_score(f).join(labels.select("address", "y"), "address").select("address", "y", "score", F.lit("none").alias("split"))
        scores = scratch.keep(scores, "scores")
        top = cohort.top_ranked(f.join(scores.select("address", "score"), "address"))
        view = top.join(cohorts, "address", "left").join(clusters.select("cluster", "risk"), "cluster", "left").join(labels.select("address", "source"), "address")
        ranking = view.select("rank", "address", "score", "cluster", "risk", "source", F.array_join(serving.report_tags(), ",").alias("tags"), serving.score_tier(F.col("score")).alias("tier"))
        return {"cohorts": cohorts, "clusters": clusters, "counts": cohort.cluster_counts(cohorts), "labels": labels, "scores": scores, "ranking": scratch.keep(ranking, "ranking")}


def write_analysis(tables: dict[str, DataFrame], path: str) -> None:
    """An analysis document: one folder of Parquet for each table."""
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def read_analysis(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
