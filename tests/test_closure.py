"""The closure by layers, and pairs by their paths to the root."""

import re

from torsia.operators import trees as T


def bushy(spark):
    """A root, 3 inner nodes, 30 below them and 300 leaves, with a long path on the side."""
    rows = [("t", 0, None, 0.0)]
    rows += [("t", 1 + i, 0, 1.0) for i in range(3)] + [("t", 10 + i, 1 + i % 3, 0.5) for i in range(30)]
    rows += [("t", 100 + i, 10 + i % 30, 0.25) for i in range(300)]
    return spark.createDataFrame(rows, "tree string, node bigint, parent bigint, branch_length double")


def brute(rows):
    up, out = {}, []
    for r in rows:
        up.setdefault(r.node, []).append((r.parent, r.branch_length))

    def walk(node, at, steps, length):
        for parent, branch in up.get(at, []):
            if parent is not None:
                out.append((node, parent, steps + 1, round(length + branch, 9)))
                walk(node, parent, steps + 1, length + branch)

    for r in rows:
        if r.parent is not None:
            out.append((r.node, r.parent, 1, r.branch_length))
            walk(r.node, r.parent, 1, r.branch_length)
    return sorted(out)


def closure(nodes):
    return sorted((r.node, r.anc, r.steps, round(r.length, 9)) for r in T.ancestors(nodes, with_self=False).collect())


def test_leaves_meet_at_their_parents_only(spark, monkeypatch):
    def never(edges):
        raise AssertionError("a tree of bushes needs no doubling")

    nodes = bushy(spark)
    monkeypatch.setattr(T, "_doubled", never)
    assert closure(nodes) == brute(nodes.collect())


def test_path_under_a_bush_and_rows_that_come_twice(spark):
    path = spark.createDataFrame([("t", 1000 + i, 999 + i if i else 100, 0.125) for i in range(700)], "tree string, node bigint, parent bigint, branch_length double")
    twice = bushy(spark).filter("node % 10 = 0 and parent is not null")
    nodes = bushy(spark).unionByName(path.filter("node < 1020")).unionByName(twice)
    assert closure(nodes) == brute(nodes.collect())


def test_pairs_are_not_multiplied_by_ancestors(spark):
    nodes = bushy(spark)
    pairs = spark.createDataFrame([("t", 100, 130), ("t", 100, 101), ("t", 100, 103), ("t", 100, 10), ("t", 7, 100)], "tree string, a bigint, b bigint")
    met = T.common_ancestor(T.ancestors(nodes), pairs)
    joins = re.findall(r"Join \w+, \((.*)\)", met._jdf.queryExecution().optimizedPlan().toString())
    assert len(joins) == 2 and not any(re.search(r"\banc#", j) for j in joins)
    assert {(r.a, r.b): (r.common, r.distance) for r in met.collect()} == {
        (100, 130): (10, 0.5), (100, 101): (0, 3.5), (100, 103): (1, 1.5), (100, 10): (10, 0.25)
    }


def test_pairs_without_a_shared_ancestor_give_no_row(spark):
    apart = spark.createDataFrame([("t", 9000, None, 0.0)], "tree string, node bigint, parent bigint, branch_length double")
    pairs = spark.createDataFrame([("t", 100, 9000), ("t", 9000, 9000)], "tree string, a bigint, b bigint")
    met = T.common_ancestor(T.ancestors(bushy(spark).unionByName(apart)), pairs)
    assert [(r.a, r.b, r.common, r.distance) for r in met.collect()] == [(9000, 9000, 9000, 0.0)]
