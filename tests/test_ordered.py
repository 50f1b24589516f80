"""Scans in blocks give what a plain window gives, whatever the block size."""

import random

import pytest
from pyspark.sql import functions as F

from torsia.operators.ordered import block_count, neighbour, numbered, running, with_blocks
from torsia.session import cut


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for key, n in (("hot", 400), ("mid", 30), ("one", 1)):
        for i, t in enumerate(sorted(rng.sample(range(10_000), n))):
            # Half of the hot rows lie close together, so widths alone do not split them.
            data.append((key, float(t if i % 2 else t // 50), i, rng.choice([None, 1.0, 2.0, 5.5]), rng.choice("abc")))
    return spark.createDataFrame(data, "k string, t double, i int, v double, s string").cache()


def sorted_rows(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("block", [3, 17, 100])
def test_running_equals_window(rows, block):
    out = {
        "total": ("sum", F.col("v")), "n": ("count", F.col("v")), "low": ("min", F.col("v")),
        "high": ("max", F.col("v")), "held": ("last", F.col("v")),
    }
    cols = ["k", "t", "i", *out]
    for inclusive in (True, False):
        whole = running(rows, ["k"], ["t", "i"], out, 10**6, inclusive)
        cut = running(rows, ["k"], ["t", "i"], out, block, inclusive)
        assert sorted_rows(whole, cols) == sorted_rows(cut, cols)


@pytest.mark.parametrize("step", [1, -1])
def test_neighbour_equals_window(rows, step):
    cols = ["k", "t", "i", "nv", "ns"]
    whole = neighbour(rows, ["k"], ["t", "i"], {"nv": "v", "ns": "s"}, step, 10**6)
    cut = neighbour(rows, ["k"], ["t", "i"], {"nv": "v", "ns": "s"}, step, 10)
    assert sorted_rows(whole, cols) == sorted_rows(cut, cols)


def test_numbers_are_complete(rows):
    got = numbered(rows, ["k"], ["t", "i"], "no", 9).groupBy("k").agg(F.count("*"), F.max("no"), F.countDistinct("no")).collect()
    assert all(r[1] == r[2] == r[3] for r in got)


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, float(i), 1.0) for i in range(50)], "k string, t double, v double")
    got = running(df, ["k"], "t", {"s": ("sum", F.col("v"))}, 5)
    assert got.agg(F.max("s")).head()[0] == 50.0 and got.count() == 50


@pytest.mark.parametrize("far", [1e12, float("inf"), float("-inf"), float("nan")])
@pytest.mark.parametrize("block", [3, 10**6])
def test_odd_orders_equal_brute_force(spark, far, block):
    """Nulls come first, NaN last; ties are told apart by the second column."""
    times = [None, None, far, *[float(i // 4) for i in range(60)]]
    data = [("k", t, i, float(i % 7)) for i, t in enumerate(times)]
    df = spark.createDataFrame(data, "k string, t double, i int, v double")
    ranked = sorted(data, key=lambda r: (0, 0, r[2]) if r[1] is None else (2, 0, r[2]) if r[1] != r[1] else (1, r[1], r[2]))
    total, sums = 0.0, {}
    for r in ranked:
        total += r[3]
        sums[r[2]] = total
    following = {a[2]: b[2] for a, b in zip(ranked, ranked[1:])}
    got = running(df, ["k"], ["t", "i"], {"s": ("sum", F.col("v"))}, block).collect()
    assert {r.i: r.s for r in got} == sums
    got = neighbour(df, ["k"], ["t", "i"], {"n": "i"}, 1, block).collect()
    assert {r.i: r.n for r in got if r.n is not None} == following and len(got) == len(data)


def test_far_value_leaves_even_blocks(spark):
    df = spark.range(10_000).select(F.lit(1).alias("k"), F.when(F.col("id") == 7, 1e12).otherwise(F.col("id") % 50).alias("t"), "id")
    sizes = [r["count"] for r in with_blocks(df, ["k"], ["t"], 32).groupBy("_block").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 2 * 10_000 / 32 * 1.5


def test_keys_smaller_than_a_block_are_not_cut(spark):
    rows = spark.range(20000).selectExpr("id % 1000 AS k", "id AS t")
    # 64 blocks at most: 312 rows each, and no key has more than 20.
    assert block_count(rows, ["k"], 9) == 1
    assert block_count(rows, ["k"], 20) == 0
    assert block_count(rows.selectExpr("k % 2 AS k", "t"), ["k"], 9) > 1
    tied = rows.selectExpr("k", "t DIV 2000 AS t", "t AS v")
    got = numbered(tied, ["k"], "t", "n", 9).join(neighbour(tied, ["k"], "t", {"next": "v"}, 1, 9), ["k", "t", "v"])
    assert got.filter("next is not null").count() == 19000
    assert numbered(tied, ["k"], "t", "n", 9).agg(F.max("n"), F.sum("n")).head() == (20, 210000)


def test_cut_stores_columns_with_rows_as_they_are(spark):
    odd = spark.sql("SELECT * FROM VALUES (1, 'a', double('NaN')), (2, NULL, -0.0D), (NULL, '', NULL) t(k, s, x)")
    kept = cut(odd)
    assert kept.inputFiles() and all(f.endswith(".parquet") for f in kept.inputFiles())
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
