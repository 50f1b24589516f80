"""Trees on small newick texts."""

import itertools

import pytest

from torsia.operators import trees as T

TEXT = "((a:1,b:2)0.9:0.5,((c:1,d:3)x:0.25,e:2):0.75,f:4)root;"


@pytest.fixture(scope="module")
def nodes(spark):
    return T.newick_nodes(spark.createDataFrame([("t", TEXT)], "tree string, newick string"), rows_per_block=5).cache()


@pytest.fixture(scope="module")
def anc(nodes):
    return T.ancestors(nodes).cache()


def by_name(nodes):
    return {r.name or f"#{r.support}": r for r in nodes.collect()}


def test_newick(nodes):
    rows = by_name(nodes)
    ids = {r.node: r for r in rows.values()}
    assert len(ids) == 10 and rows["#root"].parent is None
    assert ids[rows["c"].parent].support == "x" and rows["d"].branch_length == 3.0
    assert [rows[n].child_no for n in ("a", "b", "f")] == [1, 2, 3]
    assert ids[rows["e"].parent].branch_length == 0.75


def test_single_leaf(spark):
    got = T.newick_nodes(spark.createDataFrame([("s", "(a:0.00000);")], "tree string, newick string")).collect()
    assert sorted((r.name, r.parent is None) for r in got) == [("", True), ("a", False)]


def test_distances(spark, nodes, anc):
    ids = {r.name: r.node for r in nodes.collect() if r.name}
    want = {("a", "b"): 3.0, ("a", "c"): 3.5, ("d", "e"): 5.25, ("c", "f"): 6.0}
    pairs = spark.createDataFrame([("t", ids[a], ids[b]) for a, b in want], "tree string, a bigint, b bigint")
    got = {(r.a, r.b): r.distance for r in T.path_distance(anc, pairs).collect()}
    assert {(ids[a], ids[b]): d for (a, b), d in want.items()} == got


def test_support_rules(nodes):
    got = {r.node: r.value for r in T.branch_support(nodes).collect()}
    by = {r.support: r.node for r in nodes.collect() if r.support is not None}
    assert got[by["0.9"]] == 0.9 and got[by["x"]] == 0.0 and got[by[""]] == 1.0


def test_reroot_keeps_leaf_distances(spark, nodes, anc):
    ids = {r.name: r.node for r in nodes.collect() if r.name}
    at = spark.createDataFrame([("t", ids["d"])], "tree string, node bigint")
    new = T.reroot_edges(nodes, anc, at)
    pairs = spark.createDataFrame([("t", a, b) for a, b in itertools.combinations(sorted(ids.values()), 2)], "tree string, a bigint, b bigint")
    before = {(r.a, r.b): round(r.distance, 9) for r in T.path_distance(anc, pairs).collect()}
    after = {(r.a, r.b): round(r.distance, 9) for r in T.path_distance(T.ancestors(new), pairs).collect()}
    assert before == after and len(before) == 15


def test_prune_merges(spark, nodes, anc):
    ids = {r.name: r.node for r in nodes.collect() if r.name}
    keep = spark.createDataFrame([("t", ids[n]) for n in ("a", "c", "e")], "tree string, node bigint")
    got = {r.name: r.branch_length for r in T.prune(nodes, anc, keep).collect() if r.name}
    assert got == {"a": 1.5, "c": 1.25, "e": 2.0}


def test_layout_fills_the_unit_interval(nodes):
    rows = T.tree_layout(nodes).collect()
    tips = sorted((r.lower, r.upper) for r in rows if r.leaves == 1 and r.name)
    assert tips[0][0] == 0.0 and abs(tips[-1][1] - 1.0) < 1e-12
    assert all(abs(a[1] - b[0]) < 1e-12 for a, b in zip(tips, tips[1:]))


def test_deep_tree(spark):
    n = 100
    rows = [("t", i, i - 1 if i else None, 1.0 if i else 0.0, str(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, branch_length double, name string")
    assert T.ancestors(df).count() == n * (n + 1) // 2


def chain(spark, n, extra=()):
    rows = [("t", i, i - 1 if i else None, 1.0 if i else 0.0, str(i)) for i in range(n)]
    return spark.createDataFrame([*rows, *extra], "tree string, node bigint, parent bigint, branch_length double, name string")


def test_long_chain_in_few_rounds(spark):
    n = 300
    rows = T.tree_layout(chain(spark, n, [("t", n, n - 3, 0.5, "side")])).filter(f"node >= {n - 3} or node = 0").collect()
    got = {r.node: (r.depth, r.root_distance, r.leaves, r.lower, r.upper) for r in rows}
    assert got == {
        0: (0, 0.0, 2, 0.0, 1.0), n - 3: (n - 3, n - 3.0, 2, 0.0, 1.0), n - 2: (n - 2, n - 2.0, 1, 0.0, 0.5),
        n - 1: (n - 1, n - 1.0, 1, 0.0, 0.5), n: (n - 2, n - 2.5, 1, 0.5, 1.0),
    }
    short = {r.node: (r.parent, r.branch_length) for r in T.without_relays(chain(spark, 50, [("t", 50, 20, 0.5, "side")])).collect()}
    assert short == {0: (None, 0.0), 20: (0, 20.0), 49: (20, 29.0), 50: (20, 0.5)}


def test_sums_equal_walks_on_random_trees(spark):
    import random

    rng = random.Random(4)
    parent = {(t, i): rng.randrange(max(0, i - 1 - 9 * t), i) if i > t else None for t in range(3) for i in range(60)}
    rows = [(f"t{t}", i, p, float(i)) for (t, i), p in parent.items()]
    df = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, x double")
    up, down = {}, {}
    for t, i in parent:
        at = i
        while at is not None:
            up[t, at] = up.get((t, at), 0) + i
            down[t, i] = down.get((t, i), 0) + at
            top, at = at, parent[t, at]
        up["top", t, i] = top
    got = T.tree_sums(df, {"u": df["x"]}, {"d": df["x"]}).collect()
    assert len(got) == len(parent)
    for r in got:
        t = int(r.tree[1:])
        assert (r.u, r.d, r.top) == (up[t, r.node], down[t, r.node], up["top", t, r.node])


def test_wide_trees_need_no_rounds_of_jumps(spark, monkeypatch):
    # 3 > 12 > 240: every node but the leaves has children, so layers alone give the sums.
    rows = [("t", i, None if i < 3 else i % 3 if i < 15 else 3 + i % 12, 1) for i in range(255)]
    df = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, x bigint")
    want = {(r.node, r.top, r.u, r.d) for r in T._doubled_sums(df.withColumns({"u": df["x"], "d": df["x"]}), 255, ["u"], ["d"]).collect()}
    monkeypatch.setattr(T, "_doubled_sums", None)
    got = {(r.node, r.top, r.u, r.d) for r in T.tree_sums(df, {"u": df["x"]}, {"d": df["x"]}).collect()}
    assert got == want and sum(u for n, _, u, _ in got if n < 3) == 255


def test_a_node_without_a_value_counts_as_nothing_for_others(spark):
    rows = [("t", 0, None, 1.0), ("t", 1, 0, None), ("t", 2, 1, 4.0), ("t", 3, 1, 8.0), ("t", 4, 1, None)]
    df = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, x double")
    got = {r.node: (r.u, r.d) for r in T.tree_sums(df, {"u": df["x"]}, {"d": df["x"]}).collect()}
    assert got == {0: (13.0, 1.0), 1: (None, None), 2: (4.0, 5.0), 3: (8.0, 9.0), 4: (None, None)}


def test_a_large_table_is_dealt_out_in_more_parts(spark):
    from torsia.session import split

    df = spark.range(100).withColumnRenamed("id", "k")
    assert split(df, 10_000_000, ["k"]).rdd.getNumPartitions() == 20
    assert split(df, 1000, ["k"]).rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_circle_is_an_error(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 4, 1.0), ("t", 3, 2, 1.0), ("t", 4, 3, 1.0)]
    with pytest.raises(ValueError, match="circle"):
        T.tree_sums(spark.createDataFrame(rows, "tree string, node bigint, parent bigint, x double"))


def test_pure_clades(spark, nodes):
    ids = {r.name: r.node for r in nodes.collect() if r.name}
    traits = spark.createDataFrame([("t", ids[n], v) for n, v in zip("abcdef", (1, 1, 2, 2, 1, 2))], "tree string, node bigint, trait int")
    marks = {r.node: r.mark for r in T.pure_clades(nodes, traits).collect()}
    inner = {r.support: r.node for r in nodes.collect() if r.support}
    assert marks[inner["0.9"]] == 1 and marks[inner["x"]] == 2 and marks[ids["e"]] == 1 and marks[ids["a"]] == 0


def test_root_choice_reads_the_whole_tree(spark):
    """The query against all inner nodes x leaves of region > nation > customer > orders, walked node by node."""
    from __spark_entry__ import queries
    from torsia.catalog.tables import tree_nodes

    sf = "/root/testdata/sf0.001"
    parent, branch = {}, {}
    for r in tree_nodes(spark, sf).collect():
        parent[r.node], branch[r.node] = r.parent, r.branch_length

    def up(node):
        out, far = {}, 0.0
        while node is not None:
            out[node] = far
            far, node = far + branch[node], parent[node]
        return out

    above = {n: up(n) for n in parent}
    inner = set(parent.values()) - {None}
    leaves = [n for n in parent if n not in inner]
    assert sum(n > 1000000000 for n in leaves) > 1000
    sd = {}
    for v in inner:
        own = above[v]
        d = []
        for leaf in leaves:
            d.append(next(own[a] + far for a, far in above[leaf].items() if a in own))
        mean = sum(d) / len(d)
        sd[v] = (sum((x - mean) ** 2 for x in d) / (len(d) - 1)) ** 0.5
    best = min(sd, key=lambda v: (sd[v], v))
    (got,) = queries()["root_choice_whole"](spark, sf).collect()
    assert got.node == best and got.sd == pytest.approx(sd[best], abs=2e-6)


def test_newick_quotes_and_comments(spark):
    rows = [
        ("1", "('a (b)':1,c[&x=1,y]:2)r;"),
        ("2", " ( (a , 'it''s [x], y' : 3)0.9[c(,)]:2 , b_c:1e-2) ;\n"),
        ("3", "(5'UTR:1,[pre]'q':2)'in n':3;"),
        ("4", "(" + "x" * 20000 + "[" + "y" * 20000 + "]:1,b:2);"),
    ]
    nodes = T.newick_nodes(spark.createDataFrame(rows, "tree string, newick string")).collect()
    got = {t: [(r.node, r.parent, r["name"], r.support, r.branch_length) for r in sorted(nodes, key=lambda r: r.node) if r.tree == t] for t, _ in rows}
    assert got["1"] == [(1, None, "", "r", 0.0), (2, 1, "a (b)", None, 1.0), (3, 1, "c", None, 2.0)]
    assert got["2"] == [
        (1, None, "", "", 0.0), (2, 1, "", "0.9", 2.0), (3, 2, "a", None, 0.0), (4, 2, "it's [x], y", None, 3.0), (5, 1, "b_c", None, 0.01),
    ]
    assert got["3"] == [(1, None, "", "in n", 3.0), (2, 1, "5'UTR", None, 1.0), (3, 1, "q", None, 2.0)]
    assert got["4"] == [(1, None, "", "", 0.0), (2, 1, "x" * 20000, None, 1.0), (3, 1, "b", None, 2.0)]
