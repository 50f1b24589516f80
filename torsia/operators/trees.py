"""Phylogenies as node tables: (tree, node, parent, branch_length, name, child_no).

Sums over subtrees and over paths to the root come from ``tree_sums``: rows as many
as nodes, layer by layer from the leaves in, and in log2(depth) rounds on long paths. Operators on pairs use the closure (tree, node,
anc, steps, length), one row per node and ancestor, made layer by layer from the
leaves in, and by doubling where the tree is made of long paths.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torsia.session import cut, split

from .ordered import ROWS_PER_BLOCK, numbered, running

KEY = ["tree", "node"]


def newick_nodes(df: DataFrame, tree: str = "tree", text: str = "newick", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Node rows from newick text.

    The text becomes one row per token. A running sum gives the number of open
    brackets; the parent of a node is the last bracket opened at its level, a
    running ``last`` within (tree, level). No parser walks a tree in one task.
    Node numbers follow the order of the text, from 1. Comments in square brackets and
    blanks are left out, but for those in quoted labels, whose quotes are taken off
    (two within stand for one). Tokens of one text come from one row.
    """
    comment, quoted = r"\[[^\]]*+\]", r"'[^']*+(?:''[^']*+)*+'"
    label = rf"(?:\s++|{comment})*+(?:{quoted})?+(?:{comment}|[^(),;\[]++|\[)*+"
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(\(|\){label}|(?=[^(),;]){label})"), F.lit(1))
    clean = F.regexp_replace("tok", rf"(^\)?+{quoted})|{comment}|\s++", "$1")
    # Blanks and comments before a quoted label go first, so that the label stands at the start.
    ahead = F.regexp_replace("tok", rf"^(\)?+)(?:\s++|{comment})++", "$1")
    tokens = df.select(F.col(tree).alias("tree"), F.posexplode(found).alias("i", "tok")).withColumn("tok", ahead)
    tokens = tokens.withColumn("tok", clean).filter(F.col("tok") != "")
    opens, closes = F.col("tok") == "(", F.col("tok").startswith(")")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    leveled = running(cut(tokens), ["tree"], "i", {"_open": ("sum", step), "_no": ("sum", F.when(closes, 0).otherwise(1))}, rows_per_block)
    level = {"(": F.col("_open"), ")": F.col("_open") + 1}
    # An opening bracket is a possible parent at its own level and a child one level up.
    roles = F.when(
        opens,
        F.array(
            F.struct(F.lit("open").alias("role"), level["("].alias("level")),
            F.struct(F.lit("child").alias("role"), (F.col("_open") - 1).alias("level")),
        ),
    ).when(
        closes, F.array(F.struct(F.lit("close").alias("role"), level[")"].alias("level")))
    ).otherwise(F.array(F.struct(F.lit("child").alias("role"), F.col("_open").alias("level"))))
    rows = leveled.select("tree", "i", "tok", F.col("_no").cast("bigint").alias("no"), F.explode(roles).alias("_r")).select(
        "tree", "i", "tok", "no", F.col("_r")["role"].alias("role"), F.col("_r")["level"].cast("bigint").alias("level")
    )
    opener = F.when(F.col("role") == "open", F.col("no"))
    held = cut(running(cut(rows), ["tree", "level"], "i", {"up": ("last", opener)}, rows_per_block))
    children = held.filter("role = 'child'").select("tree", F.col("no").alias("node"), F.col("up").alias("parent"), "tok")
    labels = held.filter("role = 'close'").select("tree", F.col("up").alias("node"), F.expr("substring(tok, 2)").alias("_label"))
    j = children.join(labels, KEY, "left").withColumn("_text", F.when(F.col("tok") == "(", F.col("_label")).otherwise(F.col("tok")))
    own = F.regexp_extract("_text", rf"^({quoted})", 1)
    parts = F.split(F.expr("substring(_text, length(_own) + 1)"), ":")
    named = F.when(F.col("_own") != "", F.replace(F.expr("substring(_own, 2, length(_own) - 2)"), F.lit("''"), F.lit("'"))).otherwise(parts[0])
    inner = F.col("tok") == "("
    out = j.withColumn("_own", own).select(
        "tree", "node", "parent",
        F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(0.0)).alias("branch_length"),
        F.when(inner, F.lit("")).otherwise(named).alias("name"),
        F.when(inner, F.coalesce(named, F.lit(""))).alias("support"),
    )
    # Stored, as the numbering reads the joined rows twice.
    return numbered(cut(out), ["tree", "parent"], "node", "child_no", rows_per_block)


def ancestors(nodes: DataFrame, with_self: bool = True) -> DataFrame:
    """Closure (tree, node, anc, steps, length).

    Nodes that are nobody's parent wait until the closure of the others is known, and
    then take that of their parent; so do the nodes that are left, while each layer
    taken off is at least half of them. The rest, of long paths, double the reach
    of each round. So the many nodes below a common ancestor meet at their own
    parents, not at the few ancestors they share.
    """
    edges = cut(nodes.filter("parent is not null").select("tree", "node", "parent", F.col("branch_length").alias("length")))
    layers, rest, left = [], edges, edges.count()
    while left:
        ups = rest.select("tree", F.col("parent").alias("node")).distinct()
        inner = cut(rest.join(ups, KEY, "left_semi"))
        kept = inner.count()
        if 2 * kept > left:
            break
        layers.append(rest.join(ups, KEY, "left_anti"))
        rest, left = inner, kept
    parts = _doubled(rest) if left else []
    for layer in reversed(layers):
        own = layer.select("tree", "node", F.col("parent").alias("anc"), F.lit(1).cast("bigint").alias("steps"), "length")
        if parts:
            above = _union(parts).select("tree", F.col("node").alias("parent"), "anc", "steps", F.col("length").alias("_more"))
            own = own.unionByName(layer.join(above, ["tree", "parent"]).select(
                "tree", "node", "anc", (F.col("steps") + 1).alias("steps"), (F.col("length") + F.col("_more")).alias("length")
            ))
        parts.append(cut(own))
    none = edges.limit(0).select("tree", "node", F.col("parent").alias("anc"), F.lit(0).cast("bigint").alias("steps"), "length")
    out = _union(parts) if parts else none
    if with_self:
        own = nodes.select("tree", "node", F.col("node").alias("anc"), F.lit(0).cast("bigint").alias("steps"), F.lit(0.0).alias("length"))
        out = own.unionByName(out)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _doubled(edges: DataFrame) -> list[DataFrame]:
    """Closure of edges (tree, node, parent, length) in parts, by doubling the reach of each round."""
    reach = cut(edges.select("tree", "node", F.col("parent").alias("anc"), F.lit(1).cast("bigint").alias("steps"), "length"))
    span, parts, front = 1, [reach], reach
    while True:
        hop = front.select("tree", F.col("node").alias("anc"), F.col("anc").alias("_top"), F.col("length").alias("_more"))
        new = cut(
            _union(parts).join(hop, ["tree", "anc"]).select(
                "tree", "node", F.col("_top").alias("anc"), (F.col("steps") + span).alias("steps"), (F.col("length") + F.col("_more")).alias("length")
            )
        )
        if new.isEmpty():
            return parts
        parts.append(new)
        span *= 2
        front = new.filter(F.col("steps") == span)


#: Parents up to this number go to all tasks that hold their children.
FEW_PARENTS = 50_000


def tree_sums(nodes: DataFrame, up: dict[str, Column] = {}, down: dict[str, Column] = {}) -> DataFrame:
    """(tree, node, top, names of up and down): sums over each node's subtree and over its path to the root.

    Both hold the node itself; ``top`` is the root that it hangs from. Nodes that are
    nobody's parent give their ``up`` values to their parents and wait, and so do the
    nodes that are left, while each layer taken off is at least half of them. On the way
    back each takes from its own parent. So the many nodes below a common ancestor do
    not meet there. The rest, of long paths, double their reach each round. No step has
    more rows than there are nodes, whatever the shape, and a large table is dealt out
    in parts of bounded size.
    """
    named = nodes.select(*KEY, "parent", *[c.alias(n) for n, c in {**up, **down}.items()])
    # A node without a value of its own has no sum, but counts as nothing in those of others.
    own_null = {f"_null_{n}": F.col(n).isNull() for n in (*up, *down)}
    rest = cut(named.withColumns({**own_null, **{n: F.coalesce(n, F.lit(0)) for n in (*up, *down)}}))
    left, layers, kept_on = rest.count(), [], list(own_null)
    while left:
        ups = rest.filter("parent is not null").select("tree", F.col("parent").alias("node"), F.lit(True).alias("_up")).distinct()
        marked = cut(split(rest, left, KEY).join(ups, KEY, "left"))
        inner, layer = marked.filter("_up").drop("_up"), marked.filter("_up is null").drop("_up")
        kept = inner.count()
        if 2 * kept > left:
            break
        layers.append((layer, left, kept))
        if kept and up:
            given = layer.filter("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(*[F.sum(n).alias(f"_g_{n}") for n in up])
            inner = inner.join(given, KEY, "left").select(
                *KEY, "parent", *[(F.col(n) + F.coalesce(f"_g_{n}", F.lit(0))).alias(n) for n in up], *down, *kept_on
            )
        rest, left = (cut(inner) if up else inner), kept
    parts = [_doubled_sums(rest, left, list(up), list(down), kept_on)] if left else []
    for layer, rows, parents in reversed(layers):
        own = layer.withColumn("top", F.coalesce("parent", "node"))
        if parts:
            above = _union(parts).select("tree", F.col("node").alias("parent"), F.col("top").alias("_top"), *[F.col(n).alias(f"_m_{n}") for n in down])
            few = parents <= FEW_PARENTS
            met = (layer if few else split(layer, rows, ["tree", "parent"])).join(F.broadcast(above) if few else above, ["tree", "parent"], "left")
            own = met.select(
                *KEY, F.coalesce("_top", "parent", "node").alias("top"), *up, *[(F.col(n) + F.coalesce(f"_m_{n}", F.lit(0))).alias(n) for n in down], *kept_on
            )
        parts.append(cut(own.select(*KEY, "top", *up, *down, *kept_on)))
    out = _union(parts) if parts else rest.withColumn("top", F.col("node"))
    return out.select(*KEY, "top", *[F.when(~F.col(f"_null_{n}"), F.col(n)).alias(n) for n in (*up, *down)])


def _doubled_sums(rest: DataFrame, total: int, up: list[str], down: list[str], kept_on: Sequence[str] = ()) -> DataFrame:
    """``tree_sums`` of nodes (tree, node, parent, values) by doubling.

    After a round a node knows its ancestor 2^k steps up, the ``down`` values of
    the 2^k nodes on the way there, and the ``up`` values of all nodes less than 2^k
    steps below. What lies twice as far is what the ancestor knows of its own way,
    and what those 2^k steps below know of theirs. Nodes that have reached the root rest.
    """
    state = cut(rest.select(*KEY, F.col("parent").alias("_at"), F.col("node").alias("top"), *up, *down, *kept_on))
    span = 1
    while True:
        front = state.filter("_at is not null")
        if front.isEmpty():
            return state.drop("_at")
        if span > total:
            raise ValueError("the parents form a circle")
        above = state.select("tree", F.col("node").alias("_at"), F.col("_at").alias("_next"), F.col("top").alias("_top"),
                             *[F.col(n).alias(f"_m_{n}") for n in down])
        moved = front.join(above, ["tree", "_at"], "left").select(
            *KEY, F.col("_next").alias("_at"), F.coalesce("_top", "_at").alias("top"), *up,
            *[(F.col(n) + F.coalesce(f"_m_{n}", F.lit(0))).alias(n) for n in down], *kept_on,
        )
        new = moved.unionByName(state.filter("_at is null"))
        if up:
            gained = front.groupBy("tree", F.col("_at").alias("node")).agg(*[F.sum(n).alias(f"_g_{n}") for n in up])
            new = new.join(gained, KEY, "left").select(
                *KEY, "_at", "top", *[(F.col(n) + F.coalesce(f"_g_{n}", F.lit(0))).alias(n) for n in up], *down, *kept_on
            )
        state = cut(new)
        span *= 2


def with_children(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``_kids``, the number of children."""
    kids = nodes.filter("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_kids"))
    return split(nodes, nodes.count(), KEY).join(kids, KEY, "left").withColumn("_kids", F.coalesce("_kids", F.lit(0)))


def without_relays(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, node, parent, branch_length) without inner nodes of one child, whose branch goes to the child.

    The root stays. A run of such nodes, however long, is passed in a logarithmic
    number of rounds.
    """
    counted = cut(with_children(nodes.select(*KEY, "parent", "branch_length")))
    relay = (F.col("_kids") == 1) & F.col("parent").isNotNull()
    if counted.filter(relay).isEmpty():
        return counted.drop("_kids")
    links = counted.withColumn("parent", F.when(relay, F.col("parent")))
    runs = tree_sums(links, {}, {"_run": F.when(relay, F.col("branch_length")).otherwise(0.0)})
    above = runs.select("tree", F.col("node").alias("parent"), F.col("top").alias("_up"), "_run")
    kept = counted.filter(~relay)
    return kept.filter("parent is null").drop("_kids").unionByName(
        kept.filter("parent is not null").join(above, ["tree", "parent"]).select(
            *KEY, F.col("_up").alias("parent"), (F.col("branch_length") + F.col("_run")).alias("branch_length")
        )
    )


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    inner = nodes.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    return nodes.join(inner, KEY, "left_anti")


def common_ancestor(anc: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lowest shared ancestor and path length of the given pairs (tree, a, b).

    ``anc`` must hold each node as its own ancestor. A node's ancestors are one row,
    nearest first, so rows are pairs, and each holds two paths to the root.
    """
    paths = anc.groupBy("tree", "node").agg(F.array_sort(F.collect_list(F.struct("steps", "anc", "length"))).alias("path"))
    a, b = (paths.select("tree", F.col("node").alias(n), F.col("path").alias(f"_{n}")) for n in "ab")
    met = pairs.select("tree", "a", "b").distinct().join(a, ["tree", "a"]).join(b, ["tree", "b"])
    nearest = F.get(F.array_intersect(F.col("_a")["anc"], F.col("_b")["anc"]), F.lit(0))
    found = met.select("tree", "a", "b", "_a", "_b", nearest.alias("common")).filter("common is not null")
    reach = [F.element_at(F.col(x)["length"], F.array_position(F.col(x)["anc"], F.col("common")).cast("int")) for x in ("_a", "_b")]
    return found.select("tree", "a", "b", "common", (reach[0] + reach[1]).alias("distance"))


def path_distance(anc: DataFrame, pairs: DataFrame) -> DataFrame:
    return common_ancestor(anc, pairs).drop("common")


def branch_support(nodes: DataFrame) -> DataFrame:
    """Support per node: 1 for a blank label, 0 for one that is no number."""
    blank = F.coalesce(F.trim("support"), F.lit("")) == ""
    value = F.when(blank, 1.0).otherwise(F.coalesce(F.col("support").try_cast("double"), F.lit(0.0)))
    return nodes.select("tree", "node", value.alias("value"))


def pair_support(nodes: DataFrame, anc: DataFrame, pairs: DataFrame) -> DataFrame:
    """Support of the lowest shared ancestor of each pair."""
    met = common_ancestor(anc, pairs)
    return met.join(branch_support(nodes).withColumnRenamed("node", "common"), ["tree", "common"]).select(
        "tree", "a", "b", "common", F.col("value").alias("support")
    )


def spanned_length(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Total length of the branches from the chosen leaves to the root, each counted once."""
    marks = chosen.select(*KEY).distinct().withColumn("_chosen", F.lit(1).cast("bigint"))
    marked = nodes.join(marks, KEY, "left").withColumn("_chosen", F.coalesce("_chosen", F.lit(0)))
    used = tree_sums(marked, {"_n": F.col("_chosen")}).filter("_n > 0").select(*KEY)
    return nodes.join(used, KEY).groupBy("tree").agg(F.sum("branch_length").alias("length"))


def root_choice(nodes: DataFrame, anc: DataFrame) -> DataFrame:
    """Inner node whose distances to the leaves have the least sd: (tree, node, sd).

    Sums of distances and squares are taken up the tree first. A node's own sums
    then follow from those of its ancestors: at each ancestor, the leaves below
    it but not below the branch towards the node. Rows are nodes times depth,
    not nodes times leaves.
    """
    tips = leaves(nodes).select(*KEY)
    below = cut(
        anc.join(tips, KEY).groupBy("tree", F.col("anc").alias("node")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("length").alias("s1"), F.sum(F.col("length") * F.col("length")).alias("s2")
        )
    )
    edge = nodes.filter("parent is not null").select("tree", F.col("node").alias("anc"), "parent", "branch_length")
    low = below.select("tree", F.col("node").alias("anc"), F.col("n").alias("cn"), F.col("s1").alias("c1"), F.col("s2").alias("c2"))
    up = below.select("tree", F.col("node").alias("parent"), F.col("n").alias("un"), F.col("s1").alias("u1"), F.col("s2").alias("u2"))
    inner = nodes.join(tips, KEY, "left_anti").select(*KEY)
    rows = anc.join(inner, KEY).join(edge, ["tree", "anc"]).join(low, ["tree", "anc"]).join(up, ["tree", "parent"])
    b, reach = F.col("branch_length"), F.col("length") + F.col("branch_length")
    n = F.col("un") - F.col("cn")
    x1 = F.col("u1") - F.col("c1") - F.col("cn") * b
    x2 = F.col("u2") - F.col("c2") - 2.0 * b * F.col("c1") - F.col("cn") * b * b
    outside = rows.select(*KEY, n.alias("n"), (n * reach + x1).alias("s1"), (n * reach * reach + 2.0 * reach * x1 + x2).alias("s2"))
    own = below.join(inner, KEY).select(*KEY, "n", "s1", "s2")
    total = own.unionByName(outside).groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    sd = F.sqrt(F.when(var < 0, 0.0).otherwise(var))
    return total.withColumn("sd", sd).filter("sd is not null").groupBy("tree").agg(
        F.min_by(F.struct("node", "sd"), F.struct("sd", "node")).alias("_b")
    ).select("tree", F.col("_b")["node"].alias("node"), F.col("_b")["sd"].alias("sd"))


def reroot_edges(nodes: DataFrame, anc: DataFrame, at: DataFrame, new_root: int = -1) -> DataFrame:
    """Edges (tree, node, parent, branch_length) rooted in the middle of the branch above ``at(tree, node)``.

    Only the path from there to the old root changes: each of its branches is
    turned round. The new root has the number ``new_root``.
    """
    path = anc.join(at.select(*KEY), KEY).select("tree", F.col("anc").alias("node"), "steps")
    on_path = nodes.select(*KEY, "branch_length").join(path, KEY)
    # Node at step s gets as parent the path node at s - 1, over that one's branch.
    lower = on_path.select("tree", (F.col("steps") + 1).alias("steps"), F.col("node").alias("_down"), F.col("branch_length").alias("_b"))
    turned = on_path.join(lower, ["tree", "steps"], "left")
    new = turned.select(
        "tree", "node",
        F.when(F.col("steps") <= 1, F.lit(new_root).cast("bigint")).otherwise(F.col("_down")).alias("parent"),
        F.when(F.col("steps") == 0, F.col("branch_length") / 2.0)
        .when(F.col("steps") == 1, F.col("_b") / 2.0).otherwise(F.col("_b")).alias("branch_length"),
    )
    kept = nodes.join(path.select(*KEY), KEY, "left_anti").select(*KEY, "parent", "branch_length")
    top = at.select("tree").distinct().select(
        "tree", F.lit(new_root).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("parent"), F.lit(0.0).alias("branch_length")
    )
    return kept.unionByName(new).unionByName(top)


def prune(nodes: DataFrame, anc: DataFrame, keep: DataFrame) -> DataFrame:
    """Keep some leaves, drop the rest, and merge nodes left with one child.

    What stays are kept leaves and nodes with two or more children that lead to
    one. The new parent is the nearest such ancestor, and the closure already
    holds the length to it.
    """
    used = anc.join(keep.select(*KEY).distinct(), KEY).select("tree", F.col("anc").alias("node")).distinct()
    live = nodes.join(used, KEY)
    forks = live.filter("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_c")).filter("_c >= 2")
    solid = keep.select(*KEY).distinct().unionByName(forks.select(*KEY)).distinct()
    above = (
        anc.filter("steps > 0")
        .join(solid, KEY)
        .join(solid.withColumnRenamed("node", "anc"), ["tree", "anc"])
        .groupBy(*KEY)
        .agg(F.min_by(F.struct("anc", "length"), "steps").alias("_p"))
    )
    return solid.join(above, KEY, "left").join(nodes.select(*KEY, "name"), KEY).select(
        "tree", "node", F.col("_p")["anc"].alias("parent"), F.coalesce(F.col("_p")["length"], F.lit(0.0)).alias("branch_length"), "name"
    )


def tree_layout(nodes: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """depth, distance to root, leaves below, child number and vertical interval per node.

    Children share their parent's interval by leaf count, so a node's share is
    leaves / all leaves, and its lower end the leaves of all earlier siblings
    along the path to the root.
    """
    inner = F.col("parent").isNotNull()
    marked = cut(with_children(nodes.select(*KEY, "parent", "branch_length", "name"))).withColumn("_tip", (F.col("_kids") == 0).cast("bigint"))
    sums = tree_sums(
        marked,
        {"leaves": F.col("_tip")},
        {"depth": inner.cast("bigint"), "root_distance": F.when(inner, F.col("branch_length")).otherwise(0.0)},
    ).drop("top")
    # Read by the size check, the scan and its summary: written once.
    rows = marked.count()
    kids = cut(split(marked.select(*KEY, "parent", "name"), rows, KEY).join(sums, KEY))
    ordered = cut(running(
        kids, ["tree", "parent"], "node", {"_upto": ("sum", F.col("leaves")), "child_no": ("count", F.lit(1))}, rows_per_block
    ))
    earlier = F.when(F.col("parent").isNull(), 0).otherwise(F.col("_upto") - F.col("leaves"))
    path = tree_sums(ordered, {}, {"_before": earlier}).select(*KEY, "_before")
    total = marked.groupBy("tree").agg(F.sum("_tip").alias("_all"))
    lower = F.col("_before") / F.col("_all")
    upper = (F.col("_before") + F.col("leaves")) / F.col("_all")
    return split(ordered, rows, KEY).join(path, KEY).join(total, "tree").select(
        "tree", "node", "parent", "name", "depth", "root_distance", "leaves",
        F.when(F.col("parent").isNotNull(), F.col("child_no")).alias("child_no"),
        lower.alias("lower"), upper.alias("upper"), ((lower + upper) / 2.0).alias("mid"),
    )


def branch_scaling(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of each branch in the total of its tree, for two trees, and the ratio b / a."""
    def shares(df: DataFrame, s: str) -> DataFrame:
        inner = df.filter("parent is not null")
        total = inner.groupBy("tree").agg(F.sum("branch_length").alias("_t"))
        return inner.join(total, "tree").select(*KEY, (F.col("branch_length") / F.nullif(F.col("_t"), F.lit(0.0))).alias(f"share_{s}"))

    j = shares(a, "a").join(shares(b, "b"), KEY)
    return j.withColumn("ratio", F.col("share_b") / F.nullif(F.col("share_a"), F.lit(0.0)))


def pure_clades(nodes: DataFrame, traits: DataFrame) -> DataFrame:
    """Counts of traits 1 and 2 below each node, and ``mark``: the trait of a clade's top node.

    A node tops a clade when all its traits agree and its parent's do not.
    ``traits(tree, node, trait)`` for leaves. Leaves without trait do not count.
    """
    rows = nodes.count()
    own = split(traits, traits.count(), KEY).filter(F.col("trait").isin(1, 2)).groupBy(*KEY).agg(
        *[F.sum((F.col("trait") == k).cast("bigint")).alias(f"n{k}") for k in (1, 2)]
    )
    marked = split(nodes.select(*KEY, "parent"), rows, KEY).join(own, KEY, "left").na.fill(0, ["n1", "n2"])
    sums = tree_sums(marked, {"n1": F.col("n1"), "n2": F.col("n2")}).drop("top")
    full = cut(split(nodes.select(*KEY, "parent"), rows, KEY).join(sums, KEY))
    up = full.select("tree", F.col("node").alias("parent"), ((F.col("n1") > 0) & (F.col("n2") > 0)).alias("_mixed"))
    pure = (F.col("n1") == 0) | (F.col("n2") == 0)
    top = pure & F.coalesce(F.col("_mixed"), F.lit(False))
    # With no trait at all the first one is taken, as a maximum over equal counts gives.
    trait = F.when(F.col("n2") > F.col("n1"), 2).otherwise(1)
    return split(full, rows, ["tree", "parent"]).join(up, ["tree", "parent"], "left").select(
        "tree", "node", "n1", "n2", F.when(top, trait).otherwise(0).cast("bigint").alias("mark")
    )


def bind_leaves(nodes: DataFrame, proteins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proteins attached to leaves by name, and the leaves that have none."""
    tips = leaves(nodes).select("tree", "node", "name")
    return tips.join(proteins, "name"), tips.join(proteins.select("name").distinct(), "name", "left_anti")


# --- choosing leaves ------------------------------------------------------


def _sq_distance(a, b):
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )


def spread_selection(vectors: DataFrame, n: int, start: int, checkpoint_every: int = 8) -> DataFrame:
    """Choose n far-apart items: (rank, id, distance to those before).

    ``vectors(id, vector)``. Farthest first: each round sends one chosen vector
    to all rows, lowers their distance, and takes the farthest; ties go to the
    lower id. Distances are root-mean-square differences. Only the chosen
    vectors reach the driver; no table of pairwise distances exists.
    """
    state = vectors.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    first = state.filter(F.col("id") == start).head()
    chosen = [(1, first["id"], None)]
    last = first
    state = state.withColumn("near", F.lit(math.inf))
    for rank in range(2, n + 1):
        point = F.array(*[F.lit(float(v)) for v in last["vector"]])
        d = F.sqrt(_sq_distance(F.col("vector"), point) / F.size("vector"))
        state = state.withColumn("near", F.when(F.col("id") == last["id"], -1.0).otherwise(F.least("near", d)))
        if rank % checkpoint_every == 0:
            state = cut(state)
        best = state.agg(F.max_by(F.struct("id", "vector", "near"), F.struct("near", (-F.col("id")).alias("m"))).alias("b")).head()["b"]
        if best["near"] < 0:
            break
        chosen.append((rank, best["id"], best["near"]))
        last = best
    return vectors.sparkSession.createDataFrame(chosen, "rank bigint, id bigint, distance double")


def spread_objective(vectors: DataFrame, chosen: DataFrame, at_once: int = 64) -> DataFrame:
    """Sum over all items of the distance to the nearest chosen other item.

    The chosen vectors come in groups of ``at_once``; each group is one pass
    that lowers the distances, so any number of them works with no join.
    """
    state = vectors.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    ids = chosen.select("id").distinct()
    state_near = state.withColumn("near", F.lit(math.inf))
    group: list = []

    def lowered(df: DataFrame) -> DataFrame:
        points = F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.array(*[F.lit(v) for v in r["vector"]]).alias("v")) for r in group])
        d = F.transform(
            F.filter(points, lambda p: p["id"] != F.col("id")),
            lambda p: F.sqrt(_sq_distance(F.col("vector"), p["v"]) / F.size("vector")),
        )
        return df.withColumn("near", F.least("near", F.array_min(d)))

    for row in state.join(ids, "id", "left_semi").toLocalIterator():
        group.append(row)
        if len(group) == at_once:
            state_near, group = cut(lowered(state_near)), []
    if group:
        state_near = lowered(state_near)
    return state_near.filter(F.col("near") < math.inf).agg(F.count(F.lit(1)).alias("items"), F.sum("near").alias("objective"))
