"""Exact percentiles against numpy, also when a group is cut in blocks."""

import random

import numpy as np
import pytest

from torsia.operators.quantiles import exact_percentiles, nan_percentiles


@pytest.mark.parametrize("block", [4, 10**6])
def test_exact(spark, block):
    rng = random.Random(8)
    data = {k: [rng.choice([rng.random(), 0.5, 2.0]) for _ in range(n)] for k, n in (("a", 101), ("b", 2), ("c", 1), ("d", 10))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None)], "k string, v double")
    wanted = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", wanted, block).collect()}
    for k, vs in data.items():
        for name, p in wanted.items():
            assert abs(got[k][name] - np.percentile(vs, 100 * p)) < 1e-9


def test_nan_counts_as_fill(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 4.0), (1, 2.0)], "k int, v double")
    assert nan_percentiles(df, ["k"], "v", {"m": 0.5}).head().m == 2.0
