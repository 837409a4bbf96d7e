"""The sample of the density clustering: its size is the reference's, its memory does not grow with the square of the points."""

import tracemalloc

import numpy as np

from tallyweave.operators import cohort
from tallyweave.operators.behavior import CLUSTER_FEATURES


def test_all_of_25000_addresses_are_clustered(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cohort, "density_labels", lambda x, min_size: seen.append((len(x), min_size)) or np.zeros(len(x), int))
    f = spark.range(25_000).selectExpr("concat('a', id) as address", *[f"cast(id % {k + 7} as double) as {c}" for k, c in enumerate(CLUSTER_FEATURES)])
    assert cohort.cohorts(f).count() == 25_000
    assert seen == [(25_000, 125)]


def test_memory_of_distances():
    x = np.random.default_rng(0).normal(size=(6000, 4))
    tracemalloc.start()
    cohort.density_labels(x, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
