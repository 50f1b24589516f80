"""Sites dealt out once, and column operators that need no further deal."""

from torsia.operators import columns as C
from torsia.session import dealt


def rows_of(spark):
    data = [(f, f, c, "-A"[(f + c) % 2] if f % 3 else "A") for f in range(1, 40) for c in range(1, 6)]
    return spark.createDataFrame(data, "family bigint, protein bigint, col bigint, aa string")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_dealt_parts_follow_the_size(spark):
    df = rows_of(spark)
    assert dealt(df, ["family"], rows_per_part=5).rdd.getNumPartitions() == 39
    assert sorted(dealt(df, ["family"]).collect()) == sorted(df.collect())


def test_gap_columns_are_dropped_without_a_join(spark):
    rows = rows_of(spark)
    out = C.drop_gap_columns(rows)
    assert "Join" not in plan(out)
    assert sorted(out.collect()) == sorted(C.drop_gap_columns(rows, rows_per_block=1).collect())
    assert [(r.family, r.col) for r in out.filter("family = 1").collect()] == [(1, 1), (1, 2)]


def test_hot_family_is_numbered_in_blocks(spark):
    # One family of four fifths of the rows, so that its columns go through blocks.
    rows = spark.createDataFrame(
        [(1, p, c, "-" if c % 2 else "A") for p in (1, 2) for c in range(1, 41)] + [(2, 3, c, "A") for c in range(1, 21)],
        "family bigint, protein bigint, col bigint, aa string",
    )
    got = {(r.family, r.protein, r.col) for r in C.drop_gap_columns(rows, rows_per_block=20).collect()}
    assert got == {(1, p, c) for p in (1, 2) for c in range(1, 21)} | {(2, 3, c) for c in range(1, 21)}


def test_patterns_of_small_families_need_no_join(spark):
    rows = rows_of(spark)
    out = C.column_patterns(rows)
    assert "Join" not in plan(out)
    assert sorted(out.collect()) == sorted(C.column_patterns(rows, rows_per_family=1).collect())
    assert {(r.col, r.first_col, r.weight) for r in out.filter("family = 1").collect()} == {(1, 1, 3), (2, 2, 2), (3, 1, 3), (4, 2, 2), (5, 1, 3)}
