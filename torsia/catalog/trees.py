"""Trees: region > nation > customer > orders, with numeric columns as branch lengths."""

from pyspark.sql import functions as F

from torsia.operators import trees as ops
from torsia.operators.ordered import neighbour
from torsia.session import cut

from . import query
from .tables import r6, sql_nodes, table, tree_nodes

_CLOSURE = """anc(node, anc, steps, length) AS (
  SELECT node, node, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM nodes
  UNION ALL SELECT anc.node, n.parent, anc.steps + 1, anc.length + n.branch_length FROM anc JOIN nodes n ON n.node = anc.anc WHERE n.parent IS NOT NULL)"""
NODES, CLOSURE = sql_nodes(True), _CLOSURE
TREE = f"WITH RECURSIVE {NODES}, {CLOSURE}"
SMALL = f"WITH RECURSIVE {sql_nodes(False)}, {CLOSURE}"
_LEAF = "leaf AS (SELECT node FROM nodes WHERE node NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL))"
_PAIRS = """pr AS (SELECT node AS a, lead(node) OVER (PARTITION BY parent ORDER BY node) AS b FROM nodes
  UNION ALL SELECT node, node + 1 FROM nodes)"""
_MEET = """mt AS (SELECT pr.a, pr.b, arg_min(x.anc, x.steps) AS common, arg_min(x.length + y.length, x.steps) AS distance
  FROM pr JOIN anc x ON x.node = pr.a JOIN anc y ON y.node = pr.b AND y.anc = x.anc GROUP BY pr.a, pr.b)"""


def _tree(spark, sf, orders=True):
    # A node table is ingested once; here it is a union of five tables.
    nodes = cut(tree_nodes(spark, sf, orders))
    return nodes, ops.ancestors(nodes)


@query("ancestors", f"{TREE} SELECT node, anc, steps, round(length, 9) + 0.0 AS length FROM anc")
def _(spark, sf):
    _, anc = _tree(spark, sf)
    return anc.select("node", "anc", "steps", r6(F.col("length"), 9).alias("length"))


def _pairs(nodes):
    """Each node with the next one of its parent, and with the node numbered one higher."""
    sib = neighbour(nodes.select("tree", "parent", F.col("node").alias("a")), ["tree", "parent"], "a", {"b": "a"}, rows_per_block=100)
    near = nodes.select("tree", F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    return sib.filter("b is not null").select("tree", "a", "b").unionByName(near).distinct()


@query("path_distance", f"{TREE}, {_PAIRS}, {_MEET} SELECT a, b, common, round(distance, 9) + 0.0 AS distance FROM mt")
def _(spark, sf):
    nodes, anc = _tree(spark, sf)
    return ops.common_ancestor(anc, _pairs(nodes)).select("a", "b", "common", r6(F.col("distance"), 9).alias("distance"))


@query(
    "pair_support",
    f"""{TREE}, {_PAIRS}, {_MEET}, s AS (SELECT node, CASE WHEN node % 3 = 0 THEN 1.0 WHEN node % 3 = 1 THEN 0.0 ELSE (node % 100) / 100.0 END AS v FROM nodes)
    SELECT a, b, CAST(v AS DOUBLE) AS support FROM mt JOIN s ON s.node = common""",
)
def _(spark, sf):
    nodes, anc = _tree(spark, sf)
    label = F.when(F.col("node") % 3 == 0, " ").when(F.col("node") % 3 == 1, "clade").otherwise(((F.col("node") % 100) / 100.0).cast("string"))
    return ops.pair_support(nodes.withColumn("support", label), anc, _pairs(nodes)).select("a", "b", "support")


@query(
    "spanned_length",
    f"""{TREE}, u AS (SELECT DISTINCT anc FROM anc JOIN orders ON anc.node = o_orderkey + 1000000000 WHERE o_orderpriority = '1-URGENT')
    SELECT 't' AS tree, round(sum(branch_length), 4) AS length FROM nodes WHERE node IN (FROM u)""",
)
def _(spark, sf):
    nodes = cut(tree_nodes(spark, sf))
    chosen = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.lit("t").alias("tree"), (F.col("o_orderkey") + 1000000000).alias("node")
    )
    return ops.spanned_length(nodes, chosen).withColumn("length", F.round("length", 4))


@query(
    "root_choice",
    f"""{SMALL}, {_LEAF}, inn AS (SELECT node FROM nodes EXCEPT SELECT node FROM leaf),
      d AS (SELECT x.node AS v, y.node AS l, arg_min(x.length + y.length, x.steps) AS d FROM anc x JOIN anc y ON x.anc = y.anc
        WHERE x.node IN (FROM inn) AND y.node IN (FROM leaf) GROUP BY ALL)
    SELECT v AS node, round(stddev_samp(d), 6) + 0.0 AS sd FROM d GROUP BY v ORDER BY stddev_samp(d), v LIMIT 1""",
)
def _(spark, sf):
    nodes, anc = _tree(spark, sf, False)
    return ops.root_choice(nodes, anc).select("node", r6(F.col("sd")).alias("sd"))


# The twin of ``root_choice`` lists inner nodes x leaves of the tree without orders; this one has sums at ancestors.
@query(
    "root_choice_whole",
    f"""{TREE}, {_LEAF}, b AS (SELECT anc AS node, count(*) AS n, sum(length) AS s1, sum(length * length) AS s2 FROM anc WHERE node IN (FROM leaf) GROUP BY anc),
      w AS (SELECT x.node, x.length AS l, b.n - coalesce(c.n, 0) AS n, b.s1 - coalesce(c.s1 + c.n * m.branch_length, 0) AS s1,
          b.s2 - coalesce(c.s2 + 2 * m.branch_length * c.s1 + c.n * m.branch_length * m.branch_length, 0) AS s2
        FROM anc x JOIN b ON b.node = x.anc LEFT JOIN anc y ON y.node = x.node AND y.steps = x.steps - 1
        LEFT JOIN nodes m ON m.node = y.anc LEFT JOIN b c ON c.node = y.anc WHERE x.node NOT IN (FROM leaf)),
      d AS (SELECT node, sum(n) AS n, sum(n * l + s1) AS t1, sum(n * l * l + 2 * l * s1 + s2) AS t2 FROM w GROUP BY node)
    SELECT node, round(sqrt((t2 - t1 * t1 / n) / (n - 1)), 6) + 0.0 AS sd FROM d ORDER BY (t2 - t1 * t1 / n) / (n - 1), node LIMIT 1""",
)
def _(spark, sf):
    nodes, anc = _tree(spark, sf)
    return ops.root_choice(nodes, anc).select("node", r6(F.col("sd")).alias("sd"))


@query(
    "reroot_edges",
    f"""{TREE}, p AS (SELECT anc AS node, steps FROM anc WHERE node = 1000000007), q AS (SELECT p.node, p.steps, n.parent, n.branch_length FROM p JOIN nodes n ON n.node = p.node),
      r AS (SELECT q.node, CASE WHEN q.steps <= 1 THEN -1 ELSE d.node END AS parent,
          CASE WHEN q.steps = 0 THEN q.branch_length / 2 WHEN q.steps = 1 THEN d.branch_length / 2 ELSE d.branch_length END AS branch_length
        FROM q LEFT JOIN q d ON d.steps = q.steps - 1)
    SELECT node, parent, round(branch_length, 9) + 0.0 AS branch_length FROM r
    UNION ALL SELECT -1, NULL, 0.0
    UNION ALL SELECT node, parent, round(branch_length, 9) + 0.0 FROM nodes WHERE node NOT IN (SELECT node FROM p)""",
)
def _(spark, sf):
    nodes, anc = _tree(spark, sf)
    at = nodes.filter("node = 1000000007").select("tree", "node")
    out = ops.reroot_edges(nodes, anc, at)
    return out.select("node", "parent", r6(F.col("branch_length"), 9).alias("branch_length"))


@query(
    "prune_tree",
    f"""{TREE}, k AS (SELECT o_orderkey + 1000000000 AS node FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
      u AS (SELECT DISTINCT anc AS node FROM anc WHERE node IN (FROM k)),
      f AS (SELECT parent AS node FROM nodes WHERE node IN (FROM u) AND parent IS NOT NULL GROUP BY parent HAVING count(*) >= 2),
      s AS (SELECT node FROM k UNION SELECT node FROM f),
      a AS (SELECT node, arg_min(anc, steps) AS parent, arg_min(length, steps) AS length FROM anc WHERE steps > 0 AND node IN (FROM s) AND anc IN (FROM s) GROUP BY node)
    SELECT s.node, a.parent, round(coalesce(a.length, 0), 9) + 0.0 AS branch_length, n.name FROM s LEFT JOIN a ON a.node = s.node JOIN nodes n ON n.node = s.node""",
)
def _(spark, sf):
    nodes, anc = _tree(spark, sf)
    keep = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(
        F.lit("t").alias("tree"), (F.col("o_orderkey") + 1000000000).alias("node")
    )
    return ops.prune(nodes, anc, keep).select("node", "parent", r6(F.col("branch_length"), 9).alias("branch_length"), "name")


@query(
    "tree_layout",
    f"""{TREE}, {_LEAF}, b AS (SELECT anc AS node, count(*) AS leaves FROM anc WHERE node IN (FROM leaf) GROUP BY anc),
      s AS (SELECT n.node, n.parent, leaves, row_number() OVER w AS child_no, sum(leaves) OVER w - leaves AS earlier
        FROM nodes n JOIN b ON b.node = n.node WINDOW w AS (PARTITION BY n.parent ORDER BY n.node)),
      p AS (SELECT anc.node, sum(s.earlier) AS before, max(steps) AS depth, max(length) AS rd FROM anc JOIN s ON s.node = anc.anc GROUP BY anc.node),
      t AS (SELECT count(*) AS n FROM leaf)
    SELECT s.node, p.depth, round(rd, 9) + 0.0 AS root_distance, s.leaves, CASE WHEN parent IS NOT NULL THEN child_no END AS child_no,
      round(before / (SELECT n FROM t), 6) + 0.0 AS lower, round((before + leaves) / (SELECT n FROM t), 6) + 0.0 AS upper FROM s JOIN p ON p.node = s.node""",
)
def _(spark, sf):
    nodes = cut(tree_nodes(spark, sf))
    out = ops.tree_layout(nodes, rows_per_block=50)
    return out.select(
        "node", "depth", r6(F.col("root_distance"), 9).alias("root_distance"), "leaves", "child_no",
        r6(F.col("lower")).alias("lower"), r6(F.col("upper")).alias("upper"),
    )


@query(
    "branch_scaling",
    f"""WITH {NODES}, m AS (SELECT node, branch_length AS a, branch_length * (1 + node % 7) AS b FROM nodes WHERE parent IS NOT NULL),
      r AS (SELECT node, a / sum(a) OVER () AS sa, b / sum(b) OVER () AS sb FROM m)
    SELECT node, round(sa * 1e6, 6) + 0.0 AS share_a, round(sb * 1e6, 6) + 0.0 AS share_b, round(sb / sa, 6) + 0.0 AS ratio FROM r""",
)
def _(spark, sf):
    nodes = tree_nodes(spark, sf)
    out = ops.branch_scaling(nodes, nodes.withColumn("branch_length", F.col("branch_length") * (1 + F.col("node") % 7)))
    return out.select(
        "node", r6(F.col("share_a") * 1e6).alias("share_a"), r6(F.col("share_b") * 1e6).alias("share_b"), r6(F.col("ratio")).alias("ratio")
    )


@query(
    "pure_clades",
    f"""{TREE}, tr AS (SELECT o_orderkey + 1000000000 AS node, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS trait FROM orders),
      c AS (SELECT anc AS node, count(*) FILTER (trait = 1) AS n1, count(*) FILTER (trait = 2) AS n2 FROM anc JOIN tr ON tr.node = anc.node GROUP BY anc),
      f AS (SELECT n.node, n.parent, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM nodes n LEFT JOIN c ON c.node = n.node)
    SELECT f.node, f.n1, f.n2, CAST(CASE WHEN (f.n1 = 0 OR f.n2 = 0) AND p.n1 > 0 AND p.n2 > 0 THEN CASE WHEN f.n2 > f.n1 THEN 2 ELSE 1 END ELSE 0 END AS BIGINT) AS mark
    FROM f LEFT JOIN f p ON p.node = f.parent""",
)
def _(spark, sf):
    nodes = cut(tree_nodes(spark, sf))
    traits = table(spark, sf, "orders").select(
        F.lit("t").alias("tree"), (F.col("o_orderkey") + 1000000000).alias("node"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).alias("trait"),
    )
    return ops.pure_clades(nodes, traits).select("node", "n1", "n2", "mark")


@query(
    "bind_leaves",
    f"""WITH {sql_nodes(False)}, {_LEAF}, p AS (SELECT c_name, c_mktsegment FROM customer WHERE c_acctbal > 0)
    SELECT n.node, n.name, c_mktsegment, c_name IS NULL AS missing FROM nodes n LEFT JOIN p ON c_name = n.name WHERE n.node IN (FROM leaf)""",
)
def _(spark, sf):
    nodes = tree_nodes(spark, sf, False)
    proteins = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_name").alias("name"), "c_mktsegment")
    bound, missing = ops.bind_leaves(nodes, proteins)
    return bound.select("node", "name", "c_mktsegment", F.lit(False).alias("missing")).unionByName(
        missing.select("node", "name", F.lit(None).cast("string").alias("c_mktsegment"), F.lit(True).alias("missing"))
    )


@query(
    "newick_nodes",
    """WITH l AS (SELECT l_orderkey AS k, l_returnflag AS f, CAST(l_linenumber AS BIGINT) AS no, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
      fl AS (SELECT k, f, row_number() OVER (PARTITION BY k ORDER BY f) AS child_no FROM (SELECT DISTINCT k, f FROM l))
    SELECT k AS tree, '' AS name, NULL AS parent_support, 0.0::DOUBLE AS branch_length, CAST(1 AS BIGINT) AS child_no, 'root' AS support FROM (SELECT DISTINCT k FROM l)
    UNION ALL SELECT k, '', 'root', 0.5, child_no, f FROM fl
    UNION ALL SELECT k, 'r' || no, f, q / 4.0, row_number() OVER (PARTITION BY k, f ORDER BY no), NULL FROM l""",
)
def _(spark, sf):
    # Text of one order: at most seven lines in three groups.
    dealt = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity").repartition("l_orderkey")
    lines = dealt.groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.min("l_quantity").alias("q"))

    def listed(c):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "_t"))), lambda x: x["_t"]), ", ")

    leaf = F.concat(F.lit("r"), F.col("l_linenumber").cast("string"), F.lit(":"), (F.col("q") / 4.0).cast("string"))
    groups = lines.withColumn("_t", leaf).groupBy("l_orderkey", "l_returnflag").agg(listed("l_linenumber").alias("_x"))
    groups = groups.withColumn("_t", F.concat(F.lit("("), "_x", F.lit(")"), "l_returnflag", F.lit(":0.5")))
    trees = groups.groupBy(F.col("l_orderkey").alias("tree")).agg(F.concat(F.lit("("), listed("l_returnflag"), F.lit(")root;")).alias("newick"))
    nodes = ops.newick_nodes(trees, rows_per_block=9)
    up = nodes.select("tree", F.col("node").alias("parent"), F.col("support").alias("parent_support"))
    return nodes.join(up, ["tree", "parent"], "left").select("tree", "name", "parent_support", "branch_length", "child_no", "support")


_V = "v AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings)"


def _far(n: int) -> str:
    """CTEs c1..cn, each adding the item farthest from all before."""
    out = ["c1 AS MATERIALIZED (SELECT CAST(1 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS distance)"]
    for i in range(2, n + 1):
        out.append(
            f"""c{i} AS MATERIALIZED (SELECT * FROM c{i - 1} UNION ALL (SELECT {i}, v.id, min(sqrt(list_sum([(z[1]-z[2])*(z[1]-z[2]) for z in list_zip(v.e, w.e)]) / 64)) AS d
            FROM v CROSS JOIN c{i - 1} JOIN v w ON w.id = c{i - 1}.id WHERE v.id NOT IN (SELECT id FROM c{i - 1}) GROUP BY v.id ORDER BY d DESC, v.id LIMIT 1))"""
        )
    return ", ".join(out)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("spread_selection", f"WITH {_V}, {_far(9)} SELECT rank, id, round(distance, 6) + 0.0 AS distance FROM c9")
def _(spark, sf):
    return ops.spread_selection(_vectors(spark, sf), 9, 0).withColumn("distance", r6(F.col("distance")))


@query(
    "spread_objective",
    f"""WITH {_V}, c AS (SELECT id, e FROM v WHERE id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
      d AS (SELECT v.id, min(sqrt(list_sum([(z[1]-z[2])*(z[1]-z[2]) for z in list_zip(v.e, c.e)]) / 64)) AS d FROM v JOIN c ON c.id <> v.id GROUP BY v.id)
    SELECT count(*) AS items, round(sum(d), 5) AS objective FROM d""",
)
def _(spark, sf):
    chosen = table(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("id"))
    return ops.spread_objective(_vectors(spark, sf), chosen).withColumn("objective", F.round("objective", 5))
