"""Medians of the kept tail at every iteration against brute force."""

import random
from statistics import median

import pytest

from torsia.operators import events as E
from torsia.session import scratch_path
from torsia.streaming import traces as T


@pytest.mark.parametrize("block,parts", [(7, 2), (10_000, 3)])
def test_expanding_median(spark, block, parts):
    rng = random.Random(block)
    rows, want = [], {}
    for run, n in (("a", 90), ("b", 1), (None, 25), ("ties", 40), ("nulls", 5)):
        values = [rng.choice([None, -1.5, 0.0, 2.0]) if run == "ties" else None if run == "nulls" else rng.gauss(0, 1) for _ in range(n)]
        for i, v in enumerate(values, 1):
            rows.append((run, "p", 10 * i, v))
            tail = [x for x in values[max(1, i // parts) - 1 : i]]
            known = [x for x in tail if x is not None]
            want[run, 10 * i] = (len(tail), median(known) if known else None)
    df = spark.createDataFrame(rows, "run string, param string, iter bigint, value double").repartition(3)
    got = {(r.run, r.iter): (r.n, r.median) for r in E.expanding_median(df, parts=parts, rows_per_block=block).collect()}
    assert got.keys() == want.keys()
    for k, (n, m) in want.items():
        assert got[k][0] == n
        assert got[k][1] == pytest.approx(m, abs=1e-12) if m is not None else got[k][1] is None


def test_expanding_median_of_empty_trace(spark):
    assert E.expanding_median(spark.createDataFrame([], "run string, param string, iter bigint, value double")).count() == 0


def test_stream_goes_on_and_writes_changed_keys(spark):
    folder, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    names = "run string, iter bigint, param string, value double"

    def arrive(rows):
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").option("sep", "\t").csv(folder)

    def now():
        return {(r.run, r.param): (r.n, r.mean, r.least, r.most) for r in T.newest_statistics(spark, out).collect()}

    arrive([])
    T.follow_traces(spark, folder, out, check)
    assert now() == {}
    arrive([("a", 1, "p", 2.0), ("a", 1, "q", 5.0), ("b", 1, "p", -1.0)])
    T.follow_traces(spark, folder, out, check)
    stored = spark.read.schema(f"{T.STATISTICS}, batch bigint").parquet(out)
    before = stored.agg({"batch": "max"}).head()[0]
    # A new run of the stream, from the checkpoint of the one before.
    arrive([("a", 2, "p", 4.0)])
    T.follow_traces(spark, folder, out, check)
    assert now() == {("a", "p"): (2, 3.0, 2.0, 4.0), ("a", "q"): (1, 5.0, 5.0, 5.0), ("b", "p"): (1, -1.0, -1.0, -1.0)}
    stored = spark.read.schema(f"{T.STATISTICS}, batch bigint").parquet(out)
    assert [(r.run, r.param) for r in stored.filter(stored.batch > before).collect()] == [("a", "p")]
