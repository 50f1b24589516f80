"""Alignments bound to leaves: marks and leaves meet whole sequences, not letters."""

from torsia.plans import jobs


def test_load_alignment_deals_out_no_letters(spark):
    rows = [("f", 1, "a", "Ac-d"), ("f", 2, "b", "a-"), ("g", 3, "c", ""), ("g", 4, "d", None), ("g", 5, "a", "x"), ("g", 6, None, "A"), ("g", 7, "z", "A")]
    sequences = spark.createDataFrame(rows, "family string, seq_no bigint, name string, aligned_sequence string")
    nodes = spark.createDataFrame(
        [("t", 0, None, "root"), ("t", 1, 0, "a"), ("t", 2, 0, "b"), ("t", 3, 0, "c"), ("u", 9, None, "b")],
        "tree string, node bigint, parent bigint, name string",
    )
    blinded = spark.createDataFrame([("b",), ("b",), (None,), ("q",)], "protein string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jobs.load_alignment(sequences, nodes, blinded)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in out.select("tree", "node", "family", "seq_no", "protein", "col", "aa").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert out.columns == ["protein", "family", "seq_no", "col", "aa", "tree", "node"]
    assert got == [
        ("t", 1, "f", 1, "a", 1, "A"), ("t", 1, "f", 1, "a", 2, "C"), ("t", 1, "f", 1, "a", 3, "-"), ("t", 1, "f", 1, "a", 4, "D"),
        ("t", 1, "g", 5, "a", 1, "X"), ("t", 2, "f", 2, "b", 1, "X"), ("t", 2, "f", 2, "b", 2, "-"),
        ("u", 9, "f", 2, "b", 1, "X"), ("u", 9, "f", 2, "b", 2, "-"),
    ]
    # Letters are made above every exchange and join.
    above = plan[: plan.index("Generate")]
    assert "Exchange" not in above and "Join" not in above
