"""Tables that grow with the input never pass whole through the driver."""

import numpy as np

from torsia.llm import components, near_dedup
from torsia.llm.common import written


def _sent_whole(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_star_step(spark):
    edges = written(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long"), "edges")
    step = components._star(components._star(edges, True), False)
    assert not _sent_whole(step)
    assert {tuple(r) for r in step.collect()} == {(1, 2), (1, 3), (5, 6)}


def test_outliers_are_dealt(spark):
    # One cluster of many parts: an outlier goes to each slice, a member to each block.
    n = near_dedup.MEMBERS + 50
    like = near_dedup.to_blob((np.arange(5, dtype="u8"), np.ones(5, dtype="i8")))
    bags = written(spark.createDataFrame([(i, like) for i in range(n)], "node long, bag binary"), "bags")
    clusters = written(spark.range(1, n).selectExpr("id AS node", "0L AS root"), "clusters")
    roots = written(spark.range(10, n - 10).selectExpr("id AS node", "9L AS root"), "roots")
    found = near_dedup.outlying(bags, clusters, roots, 0.8)
    assert not _sent_whole(found)
    alone = [*range(9), *range(n - 10, n)]
    assert found.filter("b = 0").count() == n - 1 and found.count() == len(alone) * (n - 1)
